"""Exact percentiles of groups of any size.

``percentile`` keeps every distinct value of a group in one reducer. Here the distinct
values are counted first (combined on the map side), a histogram over value bins says in
which bin each wanted rank lies, the bins that are hit are cut into equal steps between their
own least and largest value and counted again, and only the steps that are hit are ranked.
The counted table is read by all steps, so the input is scanned and shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.session import reliable

BINS_PER_E = 256
STEPS = 4096  # equal steps that a hit bin is cut into
FEW_GROUPS = 1 << 16  # statistics of no more groups go to every task


def _bin(col):
    """Monotone value bin: each step of e in magnitude has ``BINS_PER_E`` bins."""
    return (F.signum(col) * F.floor(F.log1p(F.abs(col)) * BINS_PER_E)).cast("bigint")


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    n: str = "n",
) -> DataFrame:
    """One row per group: ``n`` and one linearly interpolated percentile per name in ``probs``."""
    keys = list(keys)
    inside = _hit_values(df, keys, value, probs)
    upto = Window.partitionBy(*keys, "_bin", "_step").orderBy("_x")
    inside = inside.withColumn("_hi", F.col("_start") + F.sum("_c").over(upto)).withColumn(
        "_lo", F.col("_hi") - F.col("_c")
    )
    hits = inside.withColumn("_rank", F.explode("_ranks")).where(
        (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    )
    aggs = []
    for i, p in enumerate(probs.values()):
        aggs.append(F.max(F.when(F.col("_rank") == F.floor(_position(p)), F.col("_x"))).alias(f"_l{i}"))
        aggs.append(F.max(F.when(F.col("_rank") == F.ceil(_position(p)), F.col("_x"))).alias(f"_h{i}"))
    flat = hits.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    out = [*keys, F.col("_n").alias(n)]
    for i, (name, p) in enumerate(probs.items()):
        frac = _position(p) - F.floor(_position(p))
        out.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * frac).alias(name))
    return flat.select(*out)


def _position(p: float):
    return F.lit(float(p)) * (F.col("_n") - 1)


def _on(keys: Sequence[str], pairs: Sequence[tuple[str, str]]):
    """Null-safe equality of ``pairs`` and of each key with its ``_w_`` twin."""
    on = None
    for a, b in [*pairs, *((k, f"_w_{k}") for k in keys)]:
        same = F.col(a).eqNullSafe(F.col(b))
        on = same if on is None else on & same
    return on


def _hit_values(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The counted values of the steps that hold a wanted rank, with ``_ranks`` and the rows before the step, ``_start``."""
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("_x"))
        .where(F.col("_x").isNotNull())
        .groupBy(*keys, "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_bin", _bin(F.col("_x")))
    )
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    hist = counted.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bc"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    hist = hist.withColumn("_end", F.sum("_bc").over(group.orderBy("_bin"))).withColumn("_n", F.sum("_bc").over(group))
    hist = hist.withColumn("_start", F.col("_end") - F.col("_bc"))
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(_position(p)), F.ceil(_position(p))) for p in probs.values()]))

    def hit(rows: DataFrame, wanted) -> DataFrame:
        held = F.filter(wanted, lambda r: (r >= F.col("_start")) & (r < F.col("_end")))
        return rows.withColumn("_ranks", held).where(F.size("_ranks") > 0)

    wanted = hit(hist, ranks).select(
        *[F.col(k).alias(f"_w_{k}") for k in keys], F.col("_bin").alias("_w__bin"), "_start", "_n", "_ranks", "_least", "_most"
    )
    width = F.col("_most") - F.col("_least")
    step = F.when(width > 0, F.floor((F.col("_x") - F.col("_least")) / width * STEPS)).otherwise(F.lit(0)).cast("bigint")
    inside = counted.join(wanted, _on(keys, [("_bin", "_w__bin")])).withColumn("_step", step)
    inside = inside.select(*keys, "_bin", "_step", "_x", "_c", "_start", "_n", "_ranks")

    within = Window.partitionBy(*keys, "_bin").orderBy("_step")  # at most STEPS + 1 rows
    steps = inside.groupBy(*keys, "_bin", "_step").agg(
        F.sum("_c").alias("_sc"), F.first("_start").alias("_start"), F.first("_n").alias("_n"), F.first("_ranks").alias("_ranks")
    )
    steps = steps.withColumn("_end", F.col("_start") + F.sum("_sc").over(within)).withColumn("_start", F.col("_end") - F.col("_sc"))
    found = hit(steps, F.col("_ranks")).select(
        *[F.col(k).alias(f"_w_{k}") for k in keys], F.col("_bin").alias("_w__bin"), F.col("_step").alias("_w__step"), "_start", "_n", "_ranks"
    )
    values = inside.select(*keys, "_bin", "_step", "_x", "_c")
    return values.join(found, _on(keys, [("_bin", "_w__bin"), ("_step", "_w__step")])).select(*values.columns, "_start", "_n", "_ranks")


def largest_ranked(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> int:
    """Most values that one ranking task gets."""
    return _hit_values(df, list(keys), value, probs).groupBy(*keys, "_bin", "_step").count().agg(F.max("count")).first()[0] or 0


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put one-row-per-group statistics back on the rows (one row in all when no key).

    Statistics of few groups are counted and broadcast, so that no task gets all rows of a group.
    """
    if not keys:
        return df.crossJoin(F.broadcast(stats))
    stats = reliable(stats)
    return df.join(F.broadcast(stats) if stats.count() <= FEW_GROUPS else stats, list(keys))


def with_median_gap(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and median absolute deviation per group: columns ``median`` and ``mad``."""
    med = exact_percentiles(df, keys, value, {"median": 0.5}).drop("n")
    gaps = join_stats(df.select(*keys, F.col(value).cast("double").alias("_v")), med, keys)
    gaps = gaps.withColumn("_gap", F.abs(F.col("_v") - F.col("median")))
    mad = exact_percentiles(gaps, keys, "_gap", {"mad": 0.5}).drop("n")
    return med.join(mad, list(keys)) if keys else med.crossJoin(F.broadcast(mad))
