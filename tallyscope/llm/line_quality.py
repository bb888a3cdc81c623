"""Document quality from a linear-chain conditional random field over lines.

Each line with a word is good or bad. A line's log-odds come from binned features of the line
itself and of its two neighbours; a 2 x 2 table weighs the labels of adjacent lines. The
field is trained on labelled documents, whose label stands for each of their lines.
Forward-backward gives every line its marginal probability of being good, and a document's
score is their mean weighted by line length, with its log-odds scaled to those of label 1.

Edge cases: a null or empty text, or one without words, has no lines; its score is the share of
label 1 among the training documents (0.5 without any). Without both labels in training the
field has no weights and scores that share. Null and repeated ids are rows like any other; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyscope.llm import textscan as ts

_CODES = np.arange(256)
_MASKS = {
    "symbols": np.isin(_CODES, list(b"#*$%&|<>")),
    "upper": (_CODES >= 65) & (_CODES <= 90),
    "digits": (_CODES >= 48) & (_CODES <= 57),
    "marks": np.isin(_CODES, list(b"!?")),
    "bars": _CODES == 124,
    "points": (_CODES & 0xC0) != 0x80,  # first bytes of code points
}
SHARES = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
COUNTS = (2, 4, 8, 16, 32, 64, 128)
#: Each feature and the borders of its bins.
FEATURES = {
    "symbols": SHARES, "upper": SHARES, "digits": SHARES, "marks": SHARES, "bars": SHARES, "same_next": SHARES,
    "repeated": SHARES, "seen_before": (0.5,), "words": COUNTS, "word_length": (2, 3, 4, 5, 6, 8, 12),
}
BINS = max(len(b) for b in FEATURES.values()) + 1
NO_LINE = BINS  # bin of a neighbour that does not exist
WIDTH = BINS + 1
PLACES = (0, -1, 1)  # the line, the one before, the one after


@dataclass
class Lines:
    """Lines with a word, text by text: bins by feature, length in code points, first line of each text."""

    bins: np.ndarray
    length: np.ndarray
    first: np.ndarray


def lines_of(texts: pa.Array) -> Lines:
    s = ts.scan(texts)
    prefix = s.prefix()
    row, starts, ends = ts.lines(s)
    a, b = np.searchsorted(s.starts, starts), np.searchsorted(s.starts, ends)
    holds = b > a
    row, starts, ends, a, b = row[holds], starts[holds], ends[holds], a[holds], b[holds]

    def between(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[ends] - total[starts]

    def words_between(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[b] - total[a]

    words = s.hashes(s.starts, s.ends, prefix)
    own = np.repeat(np.arange(len(texts)), np.diff(s.first)).astype(np.uint64)
    same = np.append(False, (words[1:] == words[:-1]) & (own[1:] == own[:-1]))[: len(words)]
    twice = np.zeros(len(words), bool)
    if len(words) >= 3:
        windows = ts.pair(ts.pair(ts.pair(words[:-2], words[1:-1]), words[2:]), own[2:])
        twice[2:] = ts.repeated(windows) & (own[2:] == own[:-2])
    n = b - a
    length = between(_MASKS["points"][s.data])
    inside = np.maximum(between(_MASKS["points"][s.data] & ~ts.SPACE[s.data]), 1)
    values = {k: between(_MASKS[k][s.data]) / inside for k in ("symbols", "upper", "digits", "marks", "bars")}
    values |= {"same_next": words_between(same) / n, "repeated": words_between(twice) / n, "words": n, "word_length": inside / n}
    values["seen_before"] = ts.later(ts.pair(s.hashes(starts, ends, prefix), row.astype(np.uint64)))
    bins = np.stack([np.searchsorted(np.array(cuts), values[k], side="right") for k, cuts in FEATURES.items()], axis=1)
    return Lines(bins.astype(np.int64), length, np.searchsorted(row, np.arange(len(texts) + 1)))


def active(lines: Lines) -> np.ndarray:
    """Weight numbers that each line uses: for each place and feature, its bin."""
    n, k = lines.bins.shape
    text = ts.owners(lines.first)
    out = []
    for p, place in enumerate(PLACES):
        bins = np.full((n, k), NO_LINE)
        at = np.arange(n) + place
        ok = (at >= 0) & (at < n)
        ok[ok] = text[at[ok]] == text[ok]
        bins[ok] = lines.bins[at[ok]]
        out.append(bins + (p * k + np.arange(k)) * WIDTH)
    return np.concatenate(out, axis=1) if n else np.zeros((0, 3 * k), np.int64)


class Chains:
    """Lines by position: those at one position lie in a row, longest texts first."""

    def __init__(self, first: np.ndarray):
        length = np.diff(first)
        by_length = np.argsort(-length, kind="stable")
        ranked = length[by_length]
        longest = int(ranked[0]) if len(ranked) else 0
        self.counts = np.searchsorted(-ranked, -np.arange(longest), side="left")  # texts longer than t
        self.starts = np.append(0, np.cumsum(self.counts))
        begin = first[:-1][by_length]
        self.order = np.concatenate([begin[:c] + t for t, c in enumerate(self.counts)]) if longest else np.zeros(0, np.int64)

    def at(self, t: int) -> slice:
        return slice(int(self.starts[t]), int(self.starts[t + 1]))


def marginals(odds: np.ndarray, chains: Chains, table: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each line (same order as ``odds``), and expected label pairs if asked for."""
    own = np.ones((len(odds), 2))
    own[:, 1] = np.exp(np.clip(odds[chains.order], -30, 30))
    own /= own.sum(axis=1, keepdims=True)
    move = np.exp(table - table.max())
    ahead, behind = np.empty_like(own), np.ones_like(own)
    steps = len(chains.counts)
    for t in range(steps):
        here = chains.at(t)
        now = own[here].copy()
        if t:
            now *= ahead[chains.at(t - 1)][: len(now)] @ move
        ahead[here] = now / now.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        after = chains.at(t + 1)
        n = after.stop - after.start
        onward = own[after] * behind[after]
        here = slice(chains.at(t).start, chains.at(t).start + n)
        back = onward @ move.T
        behind[here] = back / back.sum(axis=1, keepdims=True)
        if pairs:
            joint = ahead[here][:, :, None] * move * onward[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = ahead * behind
    good = np.empty(len(odds))
    good[chains.order] = both[:, 1] / both.sum(axis=1)
    return good, expected


@dataclass
class Field:
    weights: np.ndarray | None
    bias: float
    table: np.ndarray
    prior: float
    scale: tuple[float, float] = (1.0, 0.0)  # slope and shift of a document's log-odds

    def line_scores(self, lines: Lines) -> np.ndarray:
        """Marginal probability of good for each line."""
        if self.weights is None:
            return np.full(len(lines.length), self.prior)
        odds = self.weights[active(lines)].sum(axis=1) + self.bias
        return marginals(odds, Chains(lines.first), self.table)[0]

    def scores(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, for each text."""
        total = np.append(0, np.cumsum(lines.length))
        good = np.append(0, np.cumsum(self.line_scores(lines) * lines.length))
        length = np.diff(total[lines.first])
        mean = np.diff(good[lines.first]) / np.maximum(length, 1)
        if self.weights is not None:
            mean = 1 / (1 + np.exp(-(self.scale[0] * _log_odds(mean) + self.scale[1])))
        return np.clip(np.where(length > 0, mean, self.prior), 0.0, 1.0)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _calibrated(raw: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift that make the log-odds of ``raw`` those of label 1 (logistic regression by Newton's method)."""
    x = np.column_stack([_log_odds(raw), np.ones(len(raw))])
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) / len(raw) - ridge * (w - [1.0, 0.0])
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(raw) + ridge * np.eye(2), slope)
    return float(max(w[0], 0.1)), float(w[1])


def fit(lines: Lines, labels: np.ndarray, rounds: int = 300, rate: float = 0.1, penalty: float = 2e-5) -> Field:
    """Maximum conditional likelihood with an L2 penalty, by Adam over all lines at once."""
    prior = float(labels.mean()) if len(labels) else 0.5
    text = ts.owners(lines.first)
    y = labels[text].astype(float)
    n = len(y)
    if not n or y.min() == y.max():
        return Field(None, 0.0, np.zeros((2, 2)), prior)
    used, chains = active(lines), Chains(lines.first)
    size = len(PLACES) * len(FEATURES) * WIDTH
    follows = text[1:] == text[:-1]
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (follows & (y[1:] == label)).sum()
    p = np.zeros(size + 5)  # weights, bias, table
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        table = p[-4:].reshape(2, 2)
        good, expected = marginals(p[used].sum(axis=1) + p[size], chains, table, pairs=True)
        gap = y - good
        slope = np.zeros_like(p)
        slope[:size] = np.bincount(used.ravel(), np.repeat(gap, used.shape[1]), minlength=size)
        slope[size] = gap.sum()
        slope[-4:] = (seen - expected).ravel()
        slope = slope / n - penalty * p
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        p = p + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    model = Field(p[:size], float(p[size]), p[-4:].reshape(2, 2), prior)
    raw, lined = model.scores(lines), np.diff(lines.first) > 0
    model.scale = _calibrated(raw[lined], labels[lined])
    return model


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          max_labelled: int = 3_000) -> Field:
    """Fit the field on at most ``max_labelled`` labelled rows, those of the least key hashes.

    The bound keeps fitting the same at every size of the corpus; whole texts are used. The
    sampled keys, bounded by ``max_labelled``, are broadcast.
    """
    order = F.xxhash64(F.col("_k").cast("string"), F.lit("lines"))
    sample = (
        labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where(F.col("_k").isNotNull() & F.col("_y").isNotNull())
        .orderBy(order, "_k", "_y").limit(max_labelled)
    )
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(sample), "_k")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches):
            found = lines_of(batch.column("text"))
            rows = [found.bins[a:b].astype(np.int8).tobytes() for a, b in zip(found.first, found.first[1:])]
            size = [found.length[a:b].tobytes() for a, b in zip(found.first, found.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k"), batch.column("_y"), pa.array(rows, pa.binary()), pa.array(size, pa.binary())], ["_k", "_y", "bins", "size"]
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = texts.select("_k", "_y", "text").mapInArrow(run, f"_k {kind}, _y int, bins binary, size binary")
    found = rows.orderBy(order, "_k", "_y", "bins").limit(max_labelled).collect()
    bins = [np.frombuffer(bytes(r["bins"]), np.int8).reshape(-1, len(FEATURES)).astype(np.int64) for r in found]
    first = np.append(0, np.cumsum([len(b) for b in bins])).astype(np.int64)
    whole = np.concatenate(bins) if bins else np.zeros((0, len(FEATURES)), np.int64)
    length = np.concatenate([np.frombuffer(bytes(r["size"]), np.int64) for r in found]) if found else np.zeros(0, np.int64)
    return fit(Lines(whole, length, first), np.array([r["_y"] for r in found], np.int64))


def scored(docs: DataFrame, model: Field, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` without its text and with the score of the whole text, in place of any column of that name."""
    kept = [c for c in docs.columns if c not in (text, into)]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(into, DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, text):
            found = pa.array(model.scores(lines_of(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], found], [*kept, into])

    return docs.mapInArrow(run, schema)
