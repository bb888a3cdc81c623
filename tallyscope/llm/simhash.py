"""SimHash near-duplicates: tiled exact comparison of all different fingerprints.

A fingerprint has a bit set where more than half of the shingle hashes have it. Documents
with one fingerprint are one item. Items fall into tiles by the population counts of four
16-bit parts. Two fingerprints within a radius differ by no more than the radius in the sum
of these counts' differences, so a tile meets only tiles within that distance; all others
are skipped. Tile pairs are compared whole with NumPy exclusive-or and bit counts. Inside a
tile pair a local union keeps a spanning forest of the links, so a crowd of near copies
gives links in proportion to its size. Components grow from the links by rounds of
large-star and small-star joins, each cut with a written table.

Edge cases: null and empty texts have fingerprint zero and link like any other. Texts with
fewer words than a shingle hash the whole sequence. Repeated rows share a component. A null
id stays in its component but never names it, unless no row of it has an id. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyscope.llm import textscan as ts
from tallyscope.llm.storage import stored

PARTS = 4
PART_BITS = 64 // PARTS
BLOCK = 4096
#: Blocks of a tile that meet in one key.
SHARE = 4


def shingles_of(texts: pa.Array, words: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles text by text, and the number of each text's shingles."""
    s = ts.scan(texts, lower=True)
    first = s.first
    n_words = np.diff(first)
    # the words of a text joined by single spaces
    length = s.ends - s.starts
    out_end = np.cumsum(length + 1)
    out_start = out_end - length - 1
    keep = ~ts.SPACE[s.data]
    joined = np.full(int(out_end[-1]) if len(out_end) else 0, 32, np.uint8)
    place = np.ones(len(joined), bool)
    place[out_end - 1] = False
    joined[place] = s.data[keep]

    n_shingles = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    shingle_first = np.append(0, np.cumsum(n_shingles))
    row = np.repeat(np.arange(len(n_words)), n_shingles)
    begin = first[row] + np.arange(len(row)) - shingle_first[row]
    last = np.minimum(begin + words, first[row + 1]) - 1
    view, xxh = joined.tobytes(), xxhash.xxh64_intdigest
    a, b = out_start[begin].tolist(), (out_end[last] - 1).tolist()
    return np.fromiter((xxh(view[i:j], seed) for i, j in zip(a, b)), np.uint64, len(row)), n_shingles


def fingerprints_of(texts: pa.Array, words: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text, as unsigned 64-bit values."""
    return _majority(*shingles_of(texts, words, seed))


def _majority(hashes: np.ndarray, n_shingles: np.ndarray) -> np.ndarray:
    """Bits that more than half of a text's shingle hashes have."""
    shingle_first = np.append(0, np.cumsum(n_shingles))
    out = np.zeros(len(n_shingles), np.uint64)
    full = np.flatnonzero(n_shingles)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = shingle_first[full]
        # column sums between text borders, in blocks so that the running sums stay small
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        major = ones * 2 > n_shingles[full][:, None]
        out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` without its text and with its fingerprint as a signed long, in place of any column of that name."""
    kept = [c for c in docs.columns if c not in (text, into)]
    schema = StructType([*[docs.schema[c] for c in kept], StructField(into, LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, text, 2 << 20):
            found = pa.array(fingerprints_of(batch.column(text), words, seed).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], found], [*kept, into])

    return docs.mapInArrow(run, schema)


def _part_counts(values: np.ndarray) -> np.ndarray:
    """Population counts of the parts, one column each."""
    return np.stack([np.bitwise_count((values >> np.uint64(PART_BITS * k)) & np.uint64((1 << PART_BITS) - 1)) for k in range(PARTS)], axis=1)


def _tile_codes(values: np.ndarray) -> np.ndarray:
    counts = _part_counts(values).astype(np.int64)
    return sum(counts[:, k] * (PART_BITS + 1) ** k for k in range(PARTS))


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts within the radius; of each and its negative, one."""
    every = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    return [d for d in every if d >= (0,) * PARTS]


def _links(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``a`` (b is None) or between ``a`` and ``b``."""
    shift = 0 if b is None else len(a)
    b = a if b is None else b
    group, out = np.arange(len(b) + shift), []
    for lo in range(0, len(a), 256):
        close = np.bitwise_count(a[lo : lo + 256, None] ^ b[None, :]) <= radius
        for i in np.flatnonzero(close.sum(axis=1) > (shift == 0)).tolist():
            far = np.flatnonzero(close[i])
            far = far[group[far + shift] != group[lo + i]]
            while len(far):  # one link for each group that this item reaches first
                out.append((int(a[lo + i]), int(b[far[0]])))
                group[group == group[far[0] + shift]] = group[lo + i]
                far = far[group[far + shift] != group[lo + i]]
    return out


def fingerprint_links(items: DataFrame, radius: int = 3, value: str = "fingerprint") -> DataFrame:
    """Links ``(a, b)`` that connect every two of the different fingerprints within ``radius``.

    Blocks of about ``BLOCK`` fingerprints of a tile travel as one array each. Every block
    visits the tiles at its tile's side of each allowed difference, so each pair of tiles
    meets once. A tile of many blocks is visited in a square of shares: its own blocks by
    number, its visitors by hash, so that a key holds about ``SHARE`` of either side's blocks
    for each neighbouring tile, however full the tile is.
    """
    spark = items.sparkSession
    steps = _steps(radius)
    base = PART_BITS + 1

    def tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_tile_codes(values.view(np.uint64)))], ["v", "tile"])

    coded = stored(items.select(F.col(value).alias("v")).mapInArrow(tiles, "v long, tile long"), "simhash-tiles")
    # a block number for each fingerprint: hashed into as many blocks as its tile needs, twice over
    sizes = coded.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") * 2 / BLOCK).cast("int"))
    packed = (
        coded.join(sizes, "tile")
        .withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
        .groupBy("tile", "block").agg(F.collect_list("v").alias("vs"))
    )
    packed = stored(packed, "simhash-blocks")

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.array(steps, np.int64)
        for batch in batches:
            for tile, block, values in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2)):
                parts = np.array([tile // base**k % base for k in range(PARTS)])
                there = parts + moves
                there = there[((there >= 0) & (there < base)).all(axis=1)]
                codes = sum(there[:, k] * base**k for k in range(PARTS))
                n = len(codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes), pa.array(np.full(n, tile)), pa.array(np.full(n, block)), pa.array([values.as_py()] * n, pa.list_(pa.int64()))],
                    ["there", "from_tile", "from_block", "near"],
                )

    # at most 17**4 tiles, so their shares fit a broadcast
    shares = F.broadcast(sizes.select(F.col("tile").alias("there"), F.ceil(F.col("blocks") / SHARE).cast("int").alias("shares")))
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    visiting = (
        packed.mapInArrow(visits, "there long, from_tile long, from_block long, near array<long>").join(shares, "there")
        .withColumn("row", F.pmod(F.xxhash64("from_tile", "from_block"), F.col("shares")).cast("int")).withColumn("share", every)
    )
    visited = (
        packed.withColumnRenamed("tile", "there").join(shares, "there")
        .withColumn("share", F.pmod("block", F.col("shares")).cast("int")).withColumn("row", every)
    )
    pairs = visiting.join(visited.drop("shares"), ["there", "share", "row"]).where(
        (F.col("there") != F.col("from_tile")) | (F.col("block") >= F.col("from_block"))
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for here, there, m, n, near, far in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), batch.column(5)):
                a = near.values.to_numpy().view(np.uint64)
                b = None if (here, m) == (there, n) else far.values.to_numpy().view(np.uint64)
                found += _links(a, b, radius)
            if found:
                ends = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    shaped = pairs.select("from_tile", "there", "from_block", "block", "near", "vs")
    return stored(shaped.mapInArrow(compare, "a long, b long").distinct(), "simhash-links")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected links ``(a, b)``; the root is the least of its component.

    Large-star links every larger neighbour of a node to the least one around it, small-star
    every smaller one. Both together shrink paths fast; they end when nothing moves.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, before = stored(edges, "components"), None
    while True:
        around = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(edges.select("lo", "hi"))
        least = around.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = (
            around.join(least, "node").where(F.col("other") > F.col("node"))
            .select(F.col("other").alias("hi"), F.col("m").alias("lo")).where(F.col("hi") != F.col("lo")).distinct()
        )
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(down.select("hi", F.col("m").alias("lo")))
        edges = stored(small.where(F.col("hi") != F.col("lo")).distinct(), "components")
        # the same links again: every one leads to its root
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select("lo", F.col("lo")).distinct()
    )


def near_duplicates(docs: DataFrame, radius: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, fingerprint, component_id)`` of every row; the component's name is its least id."""
    rows = stored(with_fingerprint(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))), "simhash")
    items = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "simhash-items")
    found = components(fingerprint_links(items, radius))
    named = items.join(found, F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fingerprint"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fingerprint", "root").join(names, "root").select("fingerprint", "component_id")
    return rows.join(classes, "fingerprint").select(F.col("id").alias(key), "fingerprint", "component_id")


def one_of_each(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One document of each group of near copies, the one with the least id; columns as given.

    Repeated rows of that id give one row. Rows with a null id cannot be told apart by id and
    all stay.
    """
    classes = near_duplicates(docs.select("doc_id", "text"), radius)
    keep = classes.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
