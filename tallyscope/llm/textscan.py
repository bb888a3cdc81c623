"""Words and lines of many texts at once, as NumPy arrays over the bytes of an Arrow column.

A word is a maximal run of anything but space and U+0009..U+000D. All of these are single
bytes in UTF-8, so words are found on bytes. Word identity is a 64-bit hash: a polynomial
prefix hash, mixed with the length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 & ~7 | 5  # odd, and of high order modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(mix(a) * np.uint64(3) + np.asarray(b, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, np.uint64(base))
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


@dataclass
class Scan:
    """Bytes of the texts in a row, byte bounds of each text, and bounds of each word."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.searchsorted(self.starts, self.bounds)

    def prefix(self) -> np.ndarray:
        up, _ = _powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the byte ranges."""
        prefix = self.prefix() if prefix is None else prefix
        _, down = _powers(len(self.data) + 1)
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def count(self, mask: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
        """True bytes of ``mask`` in each text, or between ``bounds``."""
        bounds = self.bounds if bounds is None else bounds
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[bounds])


def scan(texts: pa.Array, lower: bool = False, within: np.ndarray = ~SPACE) -> Scan:
    """Find the runs of bytes in ``within`` (words); null texts are empty, ``lower`` folds A-Z."""
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if lower:
        data = LOWER[data]
    inside = within[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return Scan(data, bounds, np.flatnonzero(start), np.flatnonzero(end) + 1)


def owners(first: np.ndarray) -> np.ndarray:
    """Row of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:][ranked[1:] == ranked[:-1]]] = True
    return out


def lines(s: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every \\n-split line, empty ones included; a text has one line at least."""
    cut = np.flatnonzero(s.data == 10)
    starts = np.sort(np.concatenate([s.bounds[:-1], cut + 1]), kind="stable")
    ends = np.sort(np.concatenate([cut, s.bounds[1:]]), kind="stable")
    # a text's start sorts before or with the line starts inside it, its end after or with the last cut
    row_first = np.searchsorted(cut, s.bounds[:-1]) + np.arange(len(s.bounds) - 1)
    return owners(np.append(row_first, len(starts))), starts, ends
