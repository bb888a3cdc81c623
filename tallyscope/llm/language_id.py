"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, found by a forward pass; a
text's is the product over its words. The piece probabilities are learned by expectation
maximisation from counted words of labelled texts; the counting and the expectations run in
Spark, and only the tables of pieces by language (bounded by vocabulary and languages) meet
on the driver.

Words are runs of letters, in lower case, after the vocabulary's word mark. A letter that no
piece covers costs the same in every language.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is everything
when nothing is labelled. Null and repeated ids are rows like any other; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyscope.llm import textscan as ts
from tallyscope.llm.storage import stored

MARK = "▁"  # begins a word in the vocabulary
LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes of letter runs: ASCII letters, and all bytes of other characters, which ``LETTERS`` then sorts out.
_LETTER_BYTES = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
UNKNOWN = 1e-7  # probability of a letter that no piece covers
CACHED_WORDS = 1_000_000
UNDETERMINED = "und"


def read_pieces(path: str) -> list[str]:
    """Pieces of a SentencePiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(test(i) for test in skip)]


class Lattice:
    """Finds the pieces in words."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.begins = {p[:k] for p in pieces for k in range(1, len(p) + 1)}

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece number (-1: unknown letter) of every way to take a step."""
        number, begins = self.number.get, self.begins
        word, start, end, piece = [], [], [], []
        for w, text in enumerate(words):
            n = len(text)
            for i in range(n):
                single = False
                for j in range(i + 1, n + 1):
                    part = text[i:j]
                    if part not in begins:
                        break
                    p = number(part)
                    if p is not None:
                        single |= j == i + 1
                        word.append(w), start.append(i), end.append(j), piece.append(p)
                if not single:
                    word.append(w), start.append(i), end.append(i + 1), piece.append(-1)
        return tuple(np.array(x, np.int64) for x in (word, start, end, piece))


def _table(logs: np.ndarray) -> np.ndarray:
    """Probabilities with a last row for unknown letters."""
    return np.vstack([np.exp(logs), np.full((1, logs.shape[1]), UNKNOWN)])


def forward(edges, n_words: int, lengths: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward sums by node and language, the log scale of each node's word so far, and nodes' offsets.

    Nodes of a word lie in a row. Every node is scaled to a largest value of 1, so words of any
    length stay in range.
    """
    word, start, end, piece = edges
    offset = np.append(0, np.cumsum(lengths + 1))
    total = np.zeros((offset[-1], p.shape[1]))
    log = np.zeros(offset[-1])
    total[offset[:-1]] = 1.0
    order = np.lexsort((word, end))
    cuts = np.flatnonzero(np.append(True, np.diff(end[order]) != 0)) if len(order) else np.zeros(0, int)
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        mine = order[a:b]
        origin = offset[word[mine]] + start[mine]
        node = offset[word[mine]] + end[mine]
        first = np.flatnonzero(np.append(True, np.diff(node) != 0))
        at = node[first]
        base = np.maximum.reduceat(log[origin], first)
        step = np.exp(log[origin] - np.repeat(base, np.diff(np.append(first, len(node)))))
        sums = np.add.reduceat(total[origin] * p[piece[mine]] * step[:, None], first, axis=0)
        top = sums.max(axis=1)
        total[at] = sums / top[:, None]
        log[at] = base + np.log(top)
    return total, log, offset


def word_logs(words: list[str], lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over its segmentations."""
    lengths = np.array([len(w) for w in words], np.int64)
    total, log, offset = forward(lattice.edges(words), len(words), lengths, p)
    last = offset[1:] - 1
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(total[last], 1e-300)) + log[last][:, None]


def expected(words: list[str], weights: np.ndarray, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Expected piece counts by language; ``weights`` are counts by word and language."""
    lengths = np.array([len(w) for w in words], np.int64)
    edges = lattice.edges(words)
    word, start, end, piece = edges
    total, log, offset = forward(edges, len(words), lengths, p)
    # the backward sums are the forward sums of the words from behind
    turned = (word, lengths[word] - end, lengths[word] - start, piece)
    back, back_log, _ = forward(turned, len(words), lengths, p)
    origin, after = offset[word] + start, offset[word] + lengths[word] - end
    last = offset[1:] - 1
    share = total[origin] * p[piece] * back[after] * np.exp(log[origin] + back_log[after] - log[last][word])[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.nan_to_num(share / total[last][word]) * weights[word]
    out = np.zeros((len(p), p.shape[1]))
    np.add.at(out, piece, share)
    return out[:-1]


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    logs: np.ndarray  # pieces by languages


@dataclass
class _Scorer:
    """A worker's lattice and the words that it has scored, in order of their hashes."""

    lattice: Lattice
    p: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def find(self, keys: np.ndarray, text_of) -> np.ndarray:
        """Log probabilities and, in the last column, the number of letters, for sorted different keys."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        out = np.zeros((len(keys), self.p.shape[1] + 1))
        out[known] = self.rows[at[known]] if known.any() else 0
        new = np.flatnonzero(~known)
        if len(new):
            runs, owner = [], []
            for k in new.tolist():
                for run in LETTERS.findall(text_of(k).lower()):
                    runs.append(MARK + run)
                    owner.append(k)
            if runs and self.p.shape[1]:
                logs = word_logs(runs, self.lattice, self.p)
                np.add.at(out, np.array(owner), np.column_stack([logs, [len(r) - 1 for r in runs]]))
            if len(self.keys) + len(new) > CACHED_WORDS:
                self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, out.shape[1]))
            place = np.searchsorted(self.keys, keys[new])
            self.rows = np.insert(self.rows.reshape(-1, out.shape[1]), place, out[new], axis=0)
            self.keys = np.insert(self.keys, place, keys[new])
        return out


def _counted_words(rows: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of the letter runs in ``(lang, text)`` rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches):
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for word in LETTERS.findall((text or "").lower()):
                    counts[lang, word] = counts.get((lang, word), 0) + 1
            if counts:
                lang, word = zip(*counts)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(word), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", key: str = "doc_id",
          max_labelled: int = 2_000, rounds: int = 3, smooth: float = 0.1) -> Model:
    """Learn from at most ``max_labelled`` labelled texts of each language, those of the least key hashes.

    The bound keeps fitting the same at every size of the corpus. Keys are chosen without their
    texts; the chosen ones, bounded by ``max_labelled`` and the languages, are broadcast. Rows
    with a null key are not chosen.
    """
    steps = 1 << 30
    h = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("language")), F.lit(steps))
    order = Window.partitionBy("lang").orderBy("h", "key")
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("key").isNotNull()
    )
    # by count and hash about twice the wanted keys of a language meet in its task, however common it is
    counts = rows.groupBy("lang").agg((2.0 * max_labelled / F.count(F.lit(1)) * steps).alias("most"))
    offered = rows.select("lang", "key", h.alias("h")).join(F.broadcast(counts), "lang").where(F.col("h") < F.col("most"))
    chosen = offered.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_labelled)
    sample = rows.join(F.broadcast(chosen.select("lang", "key").distinct()), ["lang", "key"])
    counted = stored(_counted_words(sample), "language-words")
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    place = {x: i for i, x in enumerate(languages)}
    n = len(pieces)
    logs = np.full((n, len(languages)), -np.log(n))

    def expectations(logs: np.ndarray):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, p = Lattice(pieces), _table(logs)
            sums = np.zeros(logs.shape)
            for batch in batches:
                words = [MARK + w for w in batch.column("word").to_pylist()]
                weights = np.zeros((len(words), len(languages)))
                column = [place[x] for x in batch.column("lang").to_pylist()]
                weights[np.arange(len(words)), column] = batch.column("n").to_numpy()
                sums += expected(words, weights, lattice, p)
            piece, language = np.nonzero(sums)
            if len(piece):
                yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(sums[piece, language])], ["piece", "language", "n"])

        return run

    for _ in range(rounds if languages else 0):
        found = counted.mapInArrow(expectations(logs), "piece long, language long, n double")
        found = found.groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        sums = np.full(logs.shape, smooth)
        np.add.at(sums, (found["piece"].to_numpy(), found["language"].to_numpy()), found["n"].to_numpy())
        logs = np.log(sums) - np.log(sums.sum(axis=0))
    return Model(languages, pieces, logs)


_SCORERS: dict[int, _Scorer] = {}


def predict(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` without its text, with the likeliest language and its posterior probability, in place of columns of those names."""
    kept = [c for c in docs.columns if c not in (text, *into)]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(into[0], StringType()), StructField(into[1], DoubleType())])
    mark = hash((tuple(model.languages), model.logs.tobytes()))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by vocabulary and languages

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        if mark not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[mark] = _Scorer(Lattice(learned.pieces), _table(learned.logs))
        scorer, n = _SCORERS[mark], len(learned.languages)
        for batch in ts.slices(batches, text):
            s = ts.scan(batch.column(text), lower=True, within=_LETTER_BYTES)
            keys, at, back = np.unique(s.hashes(s.starts, s.ends), return_index=True, return_inverse=True)
            raw, starts, ends = s.data.tobytes(), s.starts[at], s.ends[at]
            rows = scorer.find(keys, lambda k: raw[starts[k] : ends[k]].decode())
            sums = np.zeros((batch.num_rows, n + 1))
            first = s.first
            full = np.flatnonzero(np.diff(first))
            if len(full):
                sums[full] = np.add.reduceat(rows[back], first[full], axis=0)
            names, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if n:
                logs = sums[:, :n]
                best = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                lettered = sums[:, n] > 0
                names = [learned.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist())]
                scores = np.where(lettered, share, 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(scores)], [*kept, *into])

    return docs.mapInArrow(run, schema)
