"""Packing documents into sequences: large-item matching, then best fit of the small ones.

Only lengths decide where a piece goes, and there are at most ``capacity`` of them. So the
plan is made from the counts by length (a histogram, bounded whatever the corpus holds), as
runs: so many pieces of one length go to so many sequences in a row. A piece finds its place
from its length and its number among the pieces of that length.

Pieces above a third of the capacity go at most two to a sequence: the longest one left is
matched with the longest that still fits beside it. Smaller ones, longest first, fill the
smallest gap that holds them; where no gap does, a new sequence starts.

Edge cases: a null or empty text is the end id alone. A text above the capacity is cut; its
last piece may be short. Repeated rows give pieces of their own. Null ids pass through. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tallyscope.llm import textscan as ts
from tallyscope.llm.storage import stored

CAPACITY = 4096
END_ID = 1
CACHED_WORDS, CACHED_PARTS = 800_000, 300_000
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII, without the apostrophe


class WordEncoder:
    """Words' ids, remembered by word hash in sorted arrays up to a bound.

    White space always separates tokens here, so words are encoded on their own. A word of
    letters and trailing ASCII punctuation falls into those two parts as well; the vocabulary's
    splitter separates letters from punctuation, and small and capital letters are one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.parts: dict[str, bytes] = {}
        self.keys, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _part(self, text: str) -> bytes:
        text = text.lower() if text.isascii() and "<|" not in text else text
        got = self.parts.get(text)
        if got is None:
            got = np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.parts) >= CACHED_PARTS:
                self.parts.clear()
            self.parts[text] = got
        return got

    def encode(self, word: bytes) -> bytes:
        """Ids of one word as little-endian 32-bit bytes."""
        text = word.decode()
        core = text.rstrip(_PUNCTUATION)
        if len(core) < len(text) and core.isalpha():
            return self._part(core) + self._part(text[len(core):])
        return self._part(text)

    def find(self, keys: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """Begin in ``flat`` and number of ids for sorted different hashes; ``words(indexes)`` gives the words to encode."""
        if len(self.keys) > CACHED_WORDS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            ids = [self.encode(w) for w in words(new)]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            begins = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
            place = at[new]
            self.keys, self.begins, self.sizes = (np.insert(a, place, v) for a, v in ((self.keys, keys[new]), (self.begins, begins), (self.sizes, sizes)))
            at = np.searchsorted(self.keys, keys)
        return self.begins[at], self.sizes[at]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded(texts: pa.Array, encode: WordEncoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with its end id, and where each text begins. Each different word is encoded once."""
    s = ts.scan(texts)
    keys, at, back = np.unique(s.hashes(s.starts, s.ends), return_index=True, return_inverse=True)
    raw, starts, ends = s.data.tobytes(), s.starts[at], s.ends[at]
    begins, sizes = encode.find(keys, lambda new: (raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())))
    length = sizes[back]
    after = np.append(0, np.cumsum(length))  # ids up to each word, ends of texts left out
    ids = encode.flat[np.repeat(begins[back] - after[:-1], length) + np.arange(after[-1])]
    begin = after[s.first] + np.arange(len(texts) + 1)
    out = np.full(begin[-1], end_id, "<u4")
    inside = np.ones(len(out), bool)
    inside[begin[1:] - 1] = False
    out[inside] = ids
    return out, begin


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, and the ``ids`` unless they are not asked for."""
    fields = [docs.schema[key], StructField("piece", IntegerType()), StructField("start", LongType()),
              StructField("length", LongType()), StructField("ids_crc32", LongType())]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in ts.slices(batches, text):
            ids, begin = encoded(batch.column(text), encode, end_id)
            cuts = [(i, k, a, min(a + capacity, hi)) for i, (lo, hi) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist()))
                    for k, a in enumerate(range(lo, hi, capacity))]
            row, piece, first, last = (np.array(x, np.int64) for x in zip(*cuts))
            crc = [zlib.crc32(ids[a:b]) for _, _, a, b in cuts]
            out = [batch.column(key).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(first - begin[row]), pa.array(last - first), pa.array(crc, pa.int64())]
            if with_ids:  # pieces lie in a row
                out.append(pa.ListArray.from_arrays(np.append(first, len(ids)).astype(np.int32), ids.view("<i4")))
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return docs.select(key, text).mapInArrow(run, StructType(fields))


#: A run of a plan: pieces number ``rank`` to ``rank + count - 1`` of a length go ``each`` to a
#: sequence, from sequence ``sequence`` on, from ``offset`` on.
Run = tuple[int, int, int, int, int, int]  # length, rank, count, each, sequence, offset


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs for so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    placed: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    open_gaps: list[int] = []
    made = 0

    def put(length: int, count: int, each: int, sequence: int, offset: int) -> None:
        runs.append((length, placed[length], count, each, sequence, offset))
        placed[length] += count
        left[length] -= count

    def gap(size: int, sequence: int, count: int) -> None:
        if size and count:
            if not gaps[size]:
                insort(open_gaps, size)
            gaps[size].append((sequence, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        if not left[longest]:
            large.pop()
            continue
        at = bisect_left(large, capacity - longest + 1) - 1
        while at >= 0 and left[large[at]] < (2 if large[at] == longest else 1):
            at -= 1
        if at < 0:
            n = left[longest]
            put(longest, n, 1, made, 0)
            gap(capacity - longest, made, n)
        elif large[at] == longest:
            n = left[longest] // 2
            put(longest, 2 * n, 2, made, 0)
            gap(capacity - 2 * longest, made, n)
        else:
            other = large[at]
            n = min(left[longest], left[other])
            put(longest, n, 1, made, 0)
            put(other, n, 1, made, longest)
            gap(capacity - longest - other, made, n)
        made += n

    for length in sorted((n for n in left if 3 * n <= capacity and left[n]), reverse=True):
        while left[length]:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                each = capacity // length
                n = -(-left[length] // each)
                gap(capacity, made, n)
                made += n
                continue
            size = open_gaps[at]
            first, n = gaps[size].pop()
            if not gaps[size]:
                open_gaps.pop(at)
            each = min(size // length, left[length])
            full = min(n, left[length] // each)
            put(length, full * each, each, first, capacity - size)
            gap(size - each * length, first, full)
            gap(size, first + full, n - full)
    return runs


def placed_pieces(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (pieces with ``length``) with their ``sequence_id`` and ``offset``.

    Pieces of a length are numbered in salted parts, so a length that a third of all rows have
    spreads over the tasks; the parts' counts (at most lengths times parts) give each its start.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c in rows.columns if c != "ids"]
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = stored(salted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "packing-sizes")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_from"))
    inside = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)) - 1
    ranked = salted.withColumn("_in", inside).join(starts, ["length", "_part"]).withColumn("_rank", F.col("_in") + F.col("_from"))

    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    kept = rows.columns
    of_length, first = np.unique(runs[:, 0], return_index=True)
    last = np.append(first[1:], len(runs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = length == n
                k = np.searchsorted(of_length, n)
                at[mine] = first[k] + np.searchsorted(runs[first[k] : last[k], 1], rank[mine], side="right") - 1
            _, begin, _, each, sequence, offset = runs[at].T
            step = rank - begin
            found = [pa.array(sequence + step // each), pa.array(offset + step % each * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *found], [*kept, "sequence_id", "offset"])

    schema = StructType([*rows.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.select(*kept, "_rank").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True, **options) -> DataFrame:
    """Pieces of all documents with their places. The pieces are written once and read twice."""
    rows = stored(pieces(docs, tokenizer, capacity=capacity, with_ids=with_ids, **options), "packing")
    return placed_pieces(rows, capacity)
