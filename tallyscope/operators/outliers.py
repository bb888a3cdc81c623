"""Outlier flags: IQR fences, z-score, modified z-score, rule anomalies, amount sanity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scores import flags
from tallyscope.operators.ordered import top_n
from tallyscope.operators.quantiles import exact_percentiles, join_stats, with_median_gap
from tallyscope.operators.stats import z_scores


def iqr_flags(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Rows with their fences and the ``is_outlier`` flag."""
    x = F.col(value).cast("double")
    cuts = exact_percentiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75}).drop("n")
    width = F.col("_q3") - F.col("_q1")
    out = join_stats(df, cuts, keys)
    out = out.withColumn("lower_bound", F.col("_q1") - reach * width).withColumn(
        "upper_bound", F.col("_q3") + reach * width
    )
    return out.withColumn("is_outlier", (x < F.col("lower_bound")) | (x > F.col("upper_bound"))).drop("_q1", "_q3")


def zscore_flags(df: DataFrame, keys: Sequence[str], value: str, bound: float = 3.0) -> DataFrame:
    return z_scores(df, keys, value, sample=False).withColumn("is_outlier", F.abs("z") > bound)


def modified_zscore_flags(df: DataFrame, keys: Sequence[str], value: str, bound: float = 3.5) -> DataFrame:
    """0.6745 (x - median) / MAD, zero where the MAD is zero."""
    out = join_stats(df, with_median_gap(df, keys, value), keys)
    x = F.col(value).cast("double")
    m = F.when(F.col("mad") != 0, 0.6745 * (x - F.col("median")) / F.col("mad")).otherwise(0.0)
    return out.withColumn("modified_z", m).withColumn("is_outlier", F.abs("modified_z") > bound)


def outlier_summary(flagged: DataFrame, keys: Sequence[str], *carried: str) -> DataFrame:
    """Count and percentage of flagged rows per group, with carried group columns."""
    return flagged.groupBy(*keys).agg(
        F.count_if("is_outlier").alias("outlier_count"),
        (F.count_if("is_outlier") * 100.0 / F.count(F.lit(1))).alias("outlier_percentage"),
        *[F.max(c).alias(c) for c in carried],
    )


def first_outliers(flagged: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 10) -> DataFrame:
    return top_n(flagged.where("is_outlier"), keys, order, n)


def rule_anomalies(df: DataFrame, key: str, amount: str, ts: str) -> DataFrame:
    """Amount outliers (|z| > 3, sample std), after-hours rows, and round hundreds when over 10 %.

    One pass gives the table-wide figures; one pass flags the rows.
    """
    x = F.col(amount).cast("double")
    is_round = x % 100 == 0
    stats = df.agg(
        F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), (F.count_if(is_round) / F.count(F.lit(1))).alias("_share")
    )
    z = F.abs((x - F.col("_m")) / F.col("_s"))
    hour = F.hour(ts)
    hits = F.array(
        F.when(z > 3, F.struct(F.lit("amount_outlier").alias("type"), z.alias("measure"))),
        F.when(~hour.between(9, 17), F.struct(F.lit("after_hours_transaction").alias("type"), hour.cast("double").alias("measure"))),
        F.when((F.col("_share") > 0.1) & is_round, F.struct(F.lit("round_number").alias("type"), x.alias("measure"))),
    )
    rows = join_stats(df, stats, [])
    return rows.select(key, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select(key, "h.*")


def amount_sanity(amount: Column) -> dict[str, Column]:
    """Suspicious-amount flags with 0.3 risk per hit."""
    hit = flags(
        (amount == F.lit(0.01), "penny_amount"),
        ((amount > 100) & (amount % 1000 == 0), "round_number"),
        (amount > 10_000_000, "extremely_large"),
    )
    risk = F.size(hit) * 0.3
    return {"flags": hit, "risk_score": F.least(risk, F.lit(1.0)), "is_safe": risk < 0.5}
