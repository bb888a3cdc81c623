"""Interpolated modified Kneser-Ney bigram model, counted in Spark and stored as sorted hash arrays.

Words are 64-bit hashes. Map tasks count words, then word pairs, as packed arrays for hash
shards; reduce tasks merge a shard and write it as one file of sorted keys and counts in the
shared folder. Pairs are sharded by their first word, so its followers are counted in place;
the followers of hot words (bounded by the number of shards) spread by the pair instead.
Scoring tasks memory-map the files and look up whole batches of sorted keys. Nothing of
corpus size passes through the driver: it reads one manifest row per file.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w)
    p(w)     = max(n(w) - D'(n(w)), 0) / n + g' / (V + 1)

c counts, n(w) counts the different words before w, n the different pairs, D and D' are
the three discounts of each order, g and g' what they free. A text is its words and one
end token, and begins after a start token.

Edge cases: a null or empty text is the end token alone. Null ids are training rows. With no
training rows every token has probability 1 / (V + 1) = 1. Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tallyscope.llm import textscan as ts
from tallyscope.llm.storage import opened, shared_folder, stored, write_once

END, START = ts.mix(np.array([1, 2], np.uint64))
BUFFER = 1_500_000  # items that a map task holds before it sends them
WORD_FIELDS = ("count", "before", "after1", "after2", "after3")  # before: different words before; afterK: followers seen K (3: or more) times
FULL = np.uint32(0xFFFFFFFF)  # stands for a count that is kept in the file's table of large counts
_BLOB = "shard int, kind string, blob binary"


def tokens(s: ts.Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, the token before each, and the first token of each text."""
    first = s.first
    words = s.hashes(s.starts, s.ends)
    n = len(first) - 1
    begin = first + np.arange(n + 1)
    now = np.empty(len(words) + n, np.uint64)
    now[begin[1:] - 1] = END
    place = np.ones(len(now), bool)
    place[begin[1:] - 1] = False
    now[place] = words
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[begin[:-1]] = START
    return now, before, begin


def pair_keys(before: np.ndarray, now: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """Pair hashes whose top ``bits`` name the shard: those of the first word, or of the pair if it is hot."""
    key = ts.pair(before, now)
    if not bits:
        return key
    lead = np.where(np.isin(before, hot), key, before) >> np.uint64(64 - bits)
    return (lead << np.uint64(64 - bits)) | (key >> np.uint64(bits))


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order and the sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def _shards(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Shard numbers and the runs of sorted keys that belong to them."""
    lead = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.searchsorted(lead, np.arange((1 << bits) + 1))
    for shard in np.unique(lead).tolist():
        yield shard, slice(int(edges[shard]), int(edges[shard + 1]))


def _rows(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    shard, kind, blob = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind), pa.array(blob, pa.binary())], ["shard", "kind", "blob"])


def _packed(keys: np.ndarray, *values: np.ndarray) -> bytes:
    return np.array([len(keys)], np.int64).tobytes() + keys.tobytes() + b"".join(v.astype(np.int64).tobytes() for v in values)


def _unpacked(blob: bytes, values: int) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return tuple(np.frombuffer(blob, np.uint64 if k == 0 else np.int64, n, 8 * (1 + k * n)) for k in range(values + 1))


def _packed_pairs(before: np.ndarray, now: np.ndarray, count: np.ndarray) -> bytes:
    """Pairs grouped by their first word, which is written once for each group."""
    order = np.argsort(before)
    before, now, count = before[order], now[order], count[order]
    first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
    head = np.array([len(first), len(now)], np.int64)
    return b"".join(x.tobytes() for x in (head, before[first], now, np.diff(np.append(first, len(now))).astype(np.uint32), count.astype(np.uint32)))


def _unpacked_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    groups, n = np.frombuffer(blob, np.int64, 2).tolist()
    at = 16
    lead = np.frombuffer(blob, np.uint64, groups, at)
    now = np.frombuffer(blob, np.uint64, n, at + 8 * groups)
    at += 8 * (groups + n)
    sizes = np.frombuffer(blob, np.uint32, groups, at)
    return np.repeat(lead, sizes), now, np.frombuffer(blob, np.uint32, n, at + 4 * groups).astype(np.int64)


def _counted_words(docs: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return _rows([(shard, "words", _packed(keys[at], counts[at])) for shard, at in _shards(keys, bits)])

        for batch in ts.slices(batches):
            now, _, _ = tokens(ts.scan(batch.column(0), lower=True))
            keys, counts = np.unique(now, return_counts=True)
            held.append((keys, counts))
            size += len(keys)
            if size > BUFFER:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, _BLOB)


def _counted_pairs(docs: DataFrame, bits: int, hot: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, before, now = (np.concatenate(x) for x in zip(*held))
            keys, at, counts = np.unique(keys, return_index=True, return_counts=True)
            before, now = before[at], now[at]
            return _rows([(shard, "pairs", _packed_pairs(before[x], now[x], counts[x])) for shard, x in _shards(keys, bits)])

        for batch in ts.slices(batches):
            now, before, _ = tokens(ts.scan(batch.column(0), lower=True))
            held.append((pair_keys(before, now, bits, hot), before, now))
            size += len(now)
            if size > BUFFER:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, _BLOB)


def _write(folder: str, name: str, keys: np.ndarray, fields: list[np.ndarray]) -> str:
    """Sorted keys, 32-bit fields, and apart the places and values of counts beyond them; their number comes last."""
    flat = np.concatenate(fields).astype(np.int64)
    large = np.flatnonzero(flat >= int(FULL))
    stream, uri = write_once(folder, name)
    with stream:
        for a in (keys, np.minimum(flat, int(FULL)).astype(np.uint32), large.astype(np.int64), flat[large], np.array([len(large)], np.int64)):
            stream.write(np.ascontiguousarray(a).tobytes())
    return uri


_MERGED = _BLOB + ", n long, tokens long, seen array<long>"


def _merged(rows: list[tuple[int, str, bytes, int, int, list[int]]]) -> pa.Table:
    shard, kind, blob, n, total, seen = zip(*rows)
    return pa.table({
        "shard": pa.array(shard, pa.int32()), "kind": pa.array(kind), "blob": pa.array(blob, pa.binary()), "n": pa.array(n, pa.int64()), "tokens": pa.array(total, pa.int64()),
        "seen": pa.array(seen, pa.list_(pa.int64())),
    })


def _seen(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _blobs(table: pa.Table, kind: str) -> list[bytes]:
    return [b for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()) if k == kind]


def _merge_words(table: pa.Table, most_hot: int) -> pa.Table:
    """Words of one shard with their counts, and its most frequent ones apart."""
    shard = table.column("shard")[0].as_py()
    parts = [_unpacked(b, 1) for b in _blobs(table, "words")]
    keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
    top = np.argsort(-counts, kind="stable")[:most_hot]
    return _merged([(shard, "words", _packed(keys, counts), len(keys), int(counts.sum()), []),
                    (shard, "top", _packed(keys[top], counts[top]), 0, 0, [])])


def _merge_pairs(table: pa.Table, folder: str, bits: int, hot: np.ndarray) -> pa.Table:
    """Write the pairs of one shard; send what they say of first and second words to the words' shards."""
    shard = table.column("shard")[0].as_py()
    before, now, counts = (np.concatenate(x) for x in zip(*(_unpacked_pairs(b) for b in _blobs(table, "pairs"))))
    keys = pair_keys(before, now, bits, hot)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.add.reduceat(counts[order], first)
    keys, before, now = keys[first], before[order][first], now[order][first]
    uri = _write(folder, f"pairs-{shard}", keys, [counts])
    rows = [(shard, "file", uri.encode(), len(keys), 0, _seen(counts))]
    for kind, word, values in (
        ("after", before, [counts == 1, counts == 2, counts >= 3]),
        ("before", now, [np.ones(len(now), np.int64)]),
    ):
        word, *values = _summed(word, *[v.astype(np.int64) for v in values])
        rows += [(to, kind, _packed(word[at], *[v[at] for v in values]), 0, 0, []) for to, at in _shards(word, bits)]
    return _merged(rows)


def _write_words(table: pa.Table, folder: str) -> pa.Table:
    """Write all that is known of the words of one shard."""
    shard = table.column("shard")[0].as_py()
    keys, values = [], []
    for kind, columns in (("words", [0]), ("before", [1]), ("after", [2, 3, 4])):
        for blob in _blobs(table, kind):
            word, *found = _unpacked(blob, len(columns))
            full = np.zeros((5, len(word)), np.int64)
            full[columns] = found
            keys.append(word)
            values.append(full)
    word, *sums = _summed(np.concatenate(keys), *np.concatenate(values, axis=1))
    uri = _write(folder, f"words-{shard}", word, sums)
    return _merged([(shard, "file", uri.encode(), len(word), 0, _seen(sums[1]))])


@dataclass
class HashFiles:
    """Sorted keys and fields of all shards, memory-mapped where a task first asks for a shard."""

    bits: int
    fields: int
    files: dict[int, tuple[str, int]]
    shipped: bool
    maps: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"maps": {}}

    def _map(self, shard: int) -> tuple[np.ndarray, ...]:
        if shard not in self.maps:
            uri, n = self.files[shard]
            path = SparkFiles.get(uri.rsplit("/", 1)[1]) if self.shipped else opened(uri)[1]
            data = np.memmap(path, np.uint8, "r")
            many, at = int(data[-8:].view(np.int64)[0]), n * (8 + 4 * self.fields)
            large = np.frombuffer(data[at : at + 16 * many].tobytes(), np.int64).reshape(2, many)
            self.maps[shard] = (np.memmap(path, np.uint64, "r", 0, (n,)), np.memmap(path, np.uint32, "r", 8 * n, (self.fields, n)), *large)
        return self.maps[shard]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Fields of each key, 0 where it is not stored."""
        unique, back = np.unique(keys, return_inverse=True)
        out = np.zeros((self.fields, len(unique)), np.int64)
        for shard, at in _shards(unique, self.bits):
            if shard in self.files:
                stored_keys, values, places, large = self._map(shard)
                wanted = unique[at]
                i = np.minimum(np.searchsorted(stored_keys, wanted), len(stored_keys) - 1)
                found = values[:, i].astype(np.int64)
                if len(large):
                    row, column = np.nonzero(found == int(FULL))
                    found[row, column] = large[np.searchsorted(places, row * len(stored_keys) + i[column])]
                out[:, at] = np.where(stored_keys[i] == wanted, found, 0)
        return out[:, back]


def discounts(seen: np.ndarray) -> np.ndarray:
    """Discounts for counts 0 to 3 and more, from how many counts are 1 to 4.

    Where a count is missing (tiny corpora) half of each count is taken.
    """
    n1, n2, n3, n4 = (float(x) for x in seen)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(raw, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


@dataclass
class Model:
    """What scoring needs besides the files; of bounded size."""

    words: HashFiles
    pairs: HashFiles
    hot: np.ndarray
    train_tokens: int
    vocabulary: int
    different_pairs: int
    word_discounts: np.ndarray
    pair_discounts: np.ndarray
    words_seen: tuple[int, int, int]  # words after 1, 2, and 3 or more different words

    def score(self, now: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of the tokens, and their training counts."""
        if not self.train_tokens:
            return np.zeros(len(now)), np.zeros(len(now), np.int64)
        both = self.words.find(np.concatenate([now, before]))
        own, lead = both[:, : len(now)], both[:, len(now) :]
        start = before == START
        after = np.where(start, self.words.find(np.array([END], np.uint64))[0, 0], lead[0])  # one start for each end
        d = self.word_discounts
        free = (d[1:] * self.words_seen).sum() / self.different_pairs
        p = np.maximum(own[1] - d[np.minimum(own[1], 3)], 0) / self.different_pairs + free / (self.vocabulary + 1)
        d = self.pair_discounts
        seen = self.pairs.find(pair_keys(before, now, self.pairs.bits, self.hot))[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = np.maximum(seen - d[np.minimum(seen, 3)], 0) / after
            back = (d[1:, None] * lead[2:]).sum(axis=0) / after
        return np.log10(np.where(after > 0, direct + back * p, p)), own[0]


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count all given texts. ``spark.sql.shuffle.partitions`` sets the number of shards."""
    spark = docs.sparkSession
    bits = max(0, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    folder = shared_folder(spark, "ngram-model")
    rows = docs.select(text).toDF("text")
    most_hot = 64

    merged = stored(_counted_words(rows, bits).groupBy("shard").applyInArrow(lambda t: _merge_words(t, most_hot), _MERGED), "ngram-words")
    totals = merged.where("kind = 'words'").agg(F.sum("n"), F.sum("tokens")).first()
    vocabulary, total = totals[0] or 0, totals[1] or 0
    # words with more than an eighth of a shard's mean share: less than 8 for each shard
    tops = [_unpacked(bytes(r["blob"]), 1) for r in merged.where("kind = 'top'").select("blob").collect()]
    hot = np.array([START, *(w for keys, counts in tops for w in keys[counts > total / (8 << bits)])], np.uint64)

    pairs = _counted_pairs(rows, bits, hot).groupBy("shard").applyInArrow(lambda t: _merge_pairs(t, folder, bits, hot), _MERGED)
    pairs = stored(pairs, "ngram-pairs")
    sent = merged.where("kind = 'words'").unionByName(pairs.where("kind <> 'file'"))
    words = stored(sent.groupBy("shard").applyInArrow(lambda t: _write_words(t, folder), _MERGED), "ngram-files")

    def manifest(df: DataFrame):
        return df.where("kind = 'file'").select("shard", "blob", "n", "seen").collect()

    pair_files, word_files = manifest(pairs), manifest(words)

    def seen(files) -> np.ndarray:
        return np.array([f["seen"] for f in files] or [[0] * 4]).sum(axis=0)

    shipped = False
    if (pair_files or word_files) and ":" in folder and not folder.startswith("file:"):
        shipped = True  # not a mounted folder: Spark copies the files to the executors
        for f in [*pair_files, *word_files]:
            spark.sparkContext.addFile(bytes(f["blob"]).decode())

    def files(found, fields: int) -> HashFiles:
        return HashFiles(bits, fields, {f["shard"]: (bytes(f["blob"]).decode(), f["n"]) for f in found}, shipped)

    word_seen = seen(word_files)
    followed = vocabulary - int(word_seen[:2].sum())
    return Model(files(word_files, 5), files(pair_files, 1), hot, total, vocabulary, sum(f["n"] for f in pair_files),
                 discounts(word_seen), discounts(seen(pair_files)), (int(word_seen[0]), int(word_seen[1]), followed))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score and score (log10), in place of columns of those names."""
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in (text, *added)]
    schema = StructType([*[docs.schema[c] for c in kept],
                         *[StructField(c, DoubleType() if "score" in c else LongType()) for c in added]])
    floor = model.train_tokens + 0.1 * (model.vocabulary + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, text):
            now, before, begin = tokens(ts.scan(batch.column(text), lower=True))
            logs, counts = model.score(now, before)
            base = np.log10((counts + 0.1) / floor)
            known = (counts > 0).astype(np.int64)
            at = begin[:-1]
            found = [np.diff(begin), np.add.reduceat(known, at), np.full(batch.num_rows, model.train_tokens),
                     np.add.reduceat(base, at), np.add.reduceat(logs, at)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, found)], [*kept, *added])

    return docs.mapInArrow(run, schema)


def held_out(key: Column, folds: int) -> Column:
    """True where crc32(key as text) mod ``folds`` is 0; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def perplexity(score_column: Column, tokens_column: Column) -> Column:
    return F.pow(F.lit(10.0), -score_column / tokens_column)
