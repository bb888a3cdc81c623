"""Exact top-k by inner product over a pivot-distance index.

A vector's key is its nearest pivot and its distance to it. The vectors of a pivot fall into
annuli by distance. For a query q and a vector x near pivot p, the triangle inequality gives
|q - x| >= | |q - p| - |x - p| |, and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, so an annulus with
its distance range and largest norm has an upper bound on the score. A query visits the annuli
from the highest bound down, some more in each round, and stops when the next bound is below
its k-th score.

Pivots and annulus borders come from a bounded sample; every vector is indexed, and the ranges
used for bounds are those of all vectors. The tables of pivots and annuli are bounded by their
numbers. Vectors travel in blocks, queries in packs; a pair of both is one matrix product. Only the
numbers of the blocks are broadcast; packs and blocks meet by a shuffle.

Edge cases: null vectors and those with null or non-finite components take no part. Shorter
vectors count as padded with zeros. Null ids take no part. Rows that share the query's id are
not its candidates. Rows repeated under one id are candidates each; as a query the id counts once,
with its least vector. Ties go to the smaller id. Empty vectors have score 0 with all. An empty
table, or one without queries, gives an empty result. Ids are integers. Scores are exact at any
size of the components; one of 2**63 or more has no place in the result and is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.storage import stored

PIVOTS = 32
RINGS = 16
SAMPLE = 20_000
BLOCK_ROWS = 2048
PACK_QUERIES = 256
FIRST_RINGS = 8
_SLACK = 1e-6  # relative room for rounding in the bounds
_ROUND = 1e-12  # and of a score as a float


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as a matrix padded with zeros."""
    out = np.zeros((len(column), width))
    length = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), length)
    begin = np.append(0, np.cumsum(length))[:-1]
    out[row, np.arange(len(flat)) - begin[row]] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; below -2**63 they stop there.

    Floats are exact while the norms' product is below 2**53, since every partial sum is; beyond it,
    64-bit integers are exact modulo 2**64, and larger components are multiplied as Python integers.
    """
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.nan_to_num(q @ x.T, nan=np.inf)
        if np.linalg.norm(q, axis=1).max() * np.linalg.norm(x, axis=1).max() < 2.0**53:
            return near.astype(np.int64)
    if max(np.abs(q).max(), np.abs(x).max()) < 2.0**63 and np.abs(near).max() < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = [[[int(c) for c in row] for row in m.tolist()] for m in (q, x)]
    exact = [[max(sum(a * b for a, b in zip(r, c)), -(1 << 63)) for c in whole[1]] for r in whole[0]]
    if max(map(max, exact)) >= 1 << 63:
        raise OverflowError("an inner product of two vectors does not fit 64 bits")
    return np.array(exact, np.int64)


def _whole(x: Column) -> Column:
    """floor(x) as a double; what is 2**52 or more has no fraction, and the built-in floor stops at 64 bits."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def usable(vectors: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """``(id, v)`` with integer components floor(scale * x) as doubles, of the vectors that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col(key).cast("long").alias("id"), F.transform(x, lambda c: _whole(c * scale)).alias("v")
    )


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS, rounds: int = 6) -> np.ndarray:
    """Means of a few rounds of k-means, from evenly spaced rows of the sample."""
    centres = sample[np.unique(np.linspace(0, len(sample) - 1, min(pivots, len(sample))).astype(int))]
    for _ in range(rounds):
        near = nearest(sample, centres)[0]
        centres = np.array([sample[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(centres)])
    return centres


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the distance to it."""
    square = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)
    near = square.argmin(axis=1)
    return near, np.linalg.norm(x - pivots[near], axis=1)


def bounds(q: np.ndarray, pivots: np.ndarray, ring_pivot: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bound of the score of each query (row) in each annulus (column)."""
    away = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] - 2 * q @ pivots.T + (pivots**2).sum(axis=1), 0))[:, ring_pivot]
    gap = np.maximum(np.maximum(low - away, away - high), 0) * (1 - _SLACK)
    own = (q**2).sum(axis=1)[:, None]
    bound = np.minimum((own + norm**2 - gap**2) / 2, np.sqrt(own) * norm)
    return np.nan_to_num(bound + _SLACK * (own + norm**2), nan=np.inf)


class Index:
    """The written blocks of all vectors, and the bounded tables of pivots and annuli."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE):
        size = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
        self.width = max(size[0] or 0, 1)
        width, self.rings_a_pivot = self.width, rings
        # the hash threshold keeps about twice the sample, so tasks send little more than the bound
        h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        few = rows.where(h < int(min(1.0, 2.0 * sample / max(size[1], 1)) * (1 << 30))).orderBy(h, "id", "v").limit(sample).select("v").toPandas()["v"]
        taken = np.zeros((len(few), width))
        for i, v in enumerate(few):
            taken[i, : len(v)] = v
        self.pivots = pivot = choose_pivots(taken, pivots) if len(taken) else np.zeros((0, width))
        if not len(taken):
            self.rings = []
            return
        near, away = nearest(taken, pivot)
        borders = [np.quantile(away[near == k], np.linspace(0, 1, rings + 1)[1:-1]) if (near == k).any() else np.zeros(rings - 1) for k in range(len(pivot))]

        def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("v"), width)
                near, away = nearest(x, pivot)
                ring = near * rings
                for k in np.unique(near):
                    mine = near == k
                    ring[mine] += np.searchsorted(borders[k], away[mine], side="right")
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), packed, pa.array(ring), pa.array(away), pa.array(np.linalg.norm(x, axis=1))], ["id", "x", "ring", "away", "norm"]
                )

        placed = stored(rows.mapInArrow(keyed, "id long, x binary, ring long, away double, norm double"), "topk-keys")
        self.rings = placed.groupBy("ring").agg(
            F.min("away").alias("low"), F.max("away").alias("high"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")
        ).orderBy("ring").collect()
        parts = {r["ring"]: -(-r["n"] // BLOCK_ROWS) for r in self.rings}
        many = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
        self.blocks = stored(
            placed.withColumn("part", F.pmod(F.xxhash64("id", "x"), many[F.col("ring")]))
            .groupBy("ring", "part").agg(F.collect_list(F.struct("id", "x")).alias("rows"))
            .select("ring", "part", F.transform("rows", lambda r: r["id"]).alias("ids"), F.transform("rows", lambda r: r["x"]).alias("xs")),
            "topk-blocks",
        )


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, id, score)`` for ``(id, v)`` queries."""
    spark = queries.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score long")
    if not index.rings:
        return empty
    width, pivots = index.width, index.pivots
    ring = np.array([r["ring"] for r in index.rings])
    low, high, norm = (np.array([r[c] for r in index.rings]) for c in ("low", "high", "norm"))
    ring_pivot = ring // index.rings_a_pivot
    one = queries.groupBy("id").agg(F.min("v").alias("v"))
    open_queries = stored(one.select(F.col("id").alias("query_id"), "v"), "topk-queries")
    packs = -(-max(open_queries.count(), 1) // PACK_QUERIES)
    parts = index.blocks.select("ring", "part")
    best, seen, upto = None, 0, FIRST_RINGS

    def visits(seen: int, upto: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column("v"), width)
                least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)  # NaN: fewer than k so far
                bound = bounds(q, pivots, ring_pivot, low, high, norm)
                order = np.argsort(-bound, axis=1, kind="stable")[:, seen:upto]
                wanted = ~(np.take_along_axis(bound, order, axis=1) < (least - np.abs(least) * _ROUND)[:, None])
                row, at = np.nonzero(wanted)
                packed = pa.array([x.tobytes() for x in q], pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ring[order[row, at]]), batch.column("query_id").take(pa.array(row)), packed, pa.array(least[row])], ["ring", "query_id", "q", "least"]
                )

        return run

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack = batch.column("pack")[i].values
                own = pack.field("query_id").to_numpy()
                q = np.frombuffer(b"".join(pack.field("q").to_pylist())).reshape(-1, width)
                least = pack.field("least").to_numpy()
                ids = batch.column("ids")[i].values.to_numpy()
                x = np.frombuffer(b"".join(batch.column("xs")[i].values.to_pylist())).reshape(-1, width)
                found = products(q, x)
                rows, columns = [], []
                for j in range(len(q)):
                    s = found[j]
                    ok = np.flatnonzero((ids != own[j]) & ~(s < least[j] - np.abs(least[j]) * _ROUND))
                    ok = ok[np.lexsort((ids[ok], -s[ok]))[:k]]
                    rows.append(np.full(len(ok), j))
                    columns.append(ok)
                row, column = np.concatenate(rows), np.concatenate(columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[row]), pa.array(ids[column]), pa.array(found[row, column])], ["query_id", "id", "score"]
                )

    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    while seen < len(ring):
        if best is None:
            state = open_queries.withColumn("least", F.lit(None).cast("double"))
        else:
            least = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("least"))
            state = open_queries.join(least, "query_id", "left")
        asked = state.mapInArrow(visits(seen, upto), "ring long, query_id long, q binary, least double")
        packed = asked.groupBy("ring", F.pmod(F.xxhash64("query_id"), F.lit(packs)).alias("p")).agg(
            F.collect_list(F.struct("query_id", "q", "least")).alias("pack")
        )
        # Spark sees neither how many annuli a query asks for nor what blocks weigh unpacked: packs and blocks are never broadcast
        met = packed.join(F.broadcast(parts), "ring").hint("merge").join(index.blocks.hint("merge"), ["ring", "part"])
        found = met.select("pack", "ids", "xs").mapInArrow(scores, "query_id long, id long, score long")
        every = found if best is None else found.unionByName(best)
        best = stored(every.withColumn("_r", F.row_number().over(by_query)).where(F.col("_r") <= k).drop("_r"), "topk-best")
        seen, upto = upto, upto * 4
    return best.withColumn("rank", F.row_number().over(by_query)).select("query_id", "rank", "id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` best other rows for each row where ``is_query`` (an expression over the key) holds."""
    rows = usable(vectors, key, vector)
    asked = usable(vectors.where(is_query), key, vector)
    return search(Index(rows), asked, k)
