"""Isolation forest: trees fit on bounded samples in parallel, one scoring pass over all rows.

Samples, split features and cuts are drawn from MD5 digests of seed, tree and node, so a forest is a
function of its rows, and SQL can grow the same one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.operators.quantiles import exact_percentiles

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length long, rows int"


def _mean_path(n: float) -> float:
    """Expected depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


#: Path lengths are kept in billionths, so that sums over trees do not depend on their order.
UNIT = 1_000_000_000


def _draw(*parts) -> float:
    """A number in [0, 1) from the MD5 of the parts, joined by colons."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2.0**32


def _drawn(*parts: Column) -> Column:
    """``_draw`` as a column."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def tree_samples(df: DataFrame, id: str, features: Sequence[str], trees: int, size: int, seed: int) -> DataFrame:
    """(tree, v): ``size`` rows per tree by smallest digest, the same on every run and layout.

    Trees are offered about ``2 * size`` rows each, whatever the number of rows: a row goes to
    as many trees in a row, from a drawn first one, as that takes, or is kept with the chance
    that gives as many. ``size`` is the model's own parameter (256 by default).
    """
    share = 2.0 * size * trees / F.greatest(F.col("_n"), F.lit(1.0))
    n = df.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    shares = n.select(share.alias("_keep"), F.least(F.lit(trees), F.ceil(share)).cast("int").alias("_offers"))
    vector = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(F.col(id).alias("_id"), vector.alias("v")).crossJoin(F.broadcast(shares))
    rows = rows.where(_drawn(F.lit(seed), F.lit("keep"), F.col("_id")) < F.col("_keep"))
    first = F.floor(_drawn(F.lit(seed), F.lit("first"), F.col("_id")) * trees)
    tries = rows.select("_id", "v", first.alias("_first"), F.explode(F.sequence(F.lit(0), F.col("_offers") - 1)).alias("_j"))
    tries = tries.select("_id", "v", F.pmod(F.col("_first") + F.col("_j"), F.lit(trees)).cast("int").alias("tree"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("tree").cast("string"), F.col("_id").cast("string")))
    w = Window.partitionBy("tree").orderBy(order, "_id")
    return tries.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).select("tree", "v")


def _grow(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """Drawn splits down to depth ceil(log2 n). Nodes are numbered as in a heap: the root is 1, below n are 2n and 2n + 1."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes, stack = [], [(1, np.arange(len(x)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        part = x[idx]
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        feature, cut = -1, 0.0
        if depth < limit and len(open_features):
            feature = int(open_features[int(_draw(seed, tree, node, "feature") * len(open_features))])
            cut = float(low[feature] + _draw(seed, tree, node, "cut") * (high[feature] - low[feature]))
            if cut <= low[feature]:
                cut = float(high[feature])
            left = part[:, feature] < cut
            stack += [(2 * node, idx[left], depth + 1), (2 * node + 1, idx[~left], depth + 1)]
        length = round((depth + _mean_path(len(idx))) * UNIT)
        nodes.append((tree, node, feature, cut, 2 * node if feature >= 0 else -1, 2 * node + 1 if feature >= 0 else -1, length, len(idx)))
    return nodes


def fit(df: DataFrame, id: str, features: Sequence[str], trees: int = 100, size: int = 256, seed: int = 42) -> DataFrame:
    """Model table: one row per tree node. Each task grows one tree from at most ``size`` rows."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _grow(int(pdf["tree"].iloc[0]), np.vstack(pdf["v"].to_numpy()), seed)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    return tree_samples(df, id, features, trees, size, seed).groupBy("tree").applyInPandas(build, NODE_SCHEMA)


def load_model(model: DataFrame) -> tuple[dict, int]:
    """Node arrays per tree. A model has at most trees * (2 * size - 1) nodes, whatever the data."""
    pdf = model.orderBy("tree", "node").toPandas()
    trees = {}
    for tree, part in pdf.groupby("tree"):
        place = {n: i for i, n in enumerate(part["node"].tolist())}
        found = {c: part[c].to_numpy() for c in ("feature", "threshold", "length", "rows")}
        trees[int(tree)] = found | {c: np.array([place.get(n, -1) for n in part[c].tolist()]) for c in ("left", "right")}
    return trees, len(trees)


def score(df: DataFrame, model: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    """Add the anomaly score 2^(-mean path / c(rows)), high for anomalies. Works on streams too.

    c is taken at the number of rows that the trees were fitted on, which their roots keep.
    """
    trees, _ = load_model(model)
    shared = df.sparkSession.sparkContext.broadcast(trees)
    features = list(features)
    norm = sum(round(_mean_path(t["rows"][0]) * UNIT) for t in trees.values()) / UNIT / max(len(trees), 1) or 1.0

    @F.pandas_udf("double")
    def evaluate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grown = list(shared.value.values())
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype=float)
                continue
            x = np.vstack(batch.to_numpy())
            rows = np.arange(len(x))
            total = np.zeros(len(x), np.int64)
            for t in grown:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = t["feature"][at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = x[rows, np.where(inner, f, 0)] < t["threshold"][at]
                    at = np.where(inner, np.where(go_left, t["left"][at], t["right"][at]), at)
                total += t["length"][at]
            yield pd.Series(np.power(2.0, -(total / UNIT / max(len(grown), 1)) / norm))

    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    return df.withColumn(out, evaluate(vector))


def flag(scored: DataFrame, contamination: float = 0.1, score_col: str = "score") -> DataFrame:
    """Threshold at the 1 - contamination percentile: is_anomaly, decision (low = anomalous), min-max risk."""
    cut = exact_percentiles(scored, [], score_col, {"_cut": 1 - contamination, "_low": 0.0, "_high": 1.0}).drop("n")
    rows = scored.crossJoin(F.broadcast(cut))
    s, width = F.col(score_col), F.col("_high") - F.col("_low")
    return (
        rows.withColumn("is_anomaly", (s > F.col("_cut")).cast("int"))
        .withColumn("decision", F.col("_cut") - s)
        .withColumn("risk_score", F.when(width > 0, (s - F.col("_low")) / width).otherwise(0.0))
        .drop("_cut", "_low", "_high")
    )


def confidence(decision):
    """1 - clamp(0.5 + decision) and its severity label, as columns."""
    value = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + decision))
    label = F.when(value >= 0.8, "high").when(value >= 0.6, "medium").when(value >= 0.4, "low").otherwise("very_low")
    return value, label
