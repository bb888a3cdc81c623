"""Fraud indicators and panels per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scores import flags


def indicators(df: DataFrame, keys: Sequence[str], amount: str, weekday: Column) -> DataFrame:
    """Round thousands over 10 %, any weekend row, duplicate amounts over 5 %.

    ``weekday`` is 0 for Sunday and 6 for Saturday. Distinct amounts are counted by
    grouping first, so a large group is combined before it meets one reducer.
    """
    keys = list(keys)
    per_amount = df.groupBy(*keys, amount).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(weekday.isin(0, 6)).alias("_weekend")
    )
    out = per_amount.groupBy(*keys).agg(
        F.sum("_n").alias("total"),
        F.sum(F.when(F.col(amount) % 1000 == 0, F.col("_n")).otherwise(0)).alias("round_count"),
        F.sum("_weekend").alias("weekend_count"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_count"),
    )
    many_round = F.col("round_count") / F.col("total") > 0.1
    weekend = F.col("weekend_count") > 0
    copies = F.col("duplicate_count") > F.col("total") * 0.05
    score = F.when(many_round, 0.3).otherwise(0.0) + F.when(weekend, 0.2).otherwise(0.0) + F.when(copies, 0.4).otherwise(0.0)
    return out.withColumn("risk_score", F.least(F.round(score, 10), F.lit(1.0))).withColumn(
        "indicators", flags((many_round, "round_numbers"), (weekend, "weekend"), (copies, "duplicate_amounts"))
    )


def vendor_share(df: DataFrame, keys: Sequence[str], vendor: str, amount: str) -> DataFrame:
    """Each vendor's share of its group's total."""
    keys = list(keys)
    by_vendor = df.groupBy(*keys, vendor).agg(F.sum(amount).alias("paid"))
    totals = by_vendor.groupBy(*keys).agg(F.sum("paid").alias("_all"))
    rows = by_vendor.join(totals, keys) if keys else by_vendor.crossJoin(F.broadcast(totals))
    return rows.withColumn("share", F.col("paid").cast("double") / F.col("_all").cast("double")).drop("_all")


def panel(df: DataFrame, keys: Sequence[str], business_key: Sequence[str], amount: str, vendor: str, unusual: Column) -> DataFrame:
    """Identical transactions, round-number share, unusual-time count, top-vendor share, with labels."""
    keys = list(keys)
    copies = df.groupBy(*keys, *business_key).count().groupBy(*keys).agg(F.sum(F.col("count") - 1).alias("duplicate_transactions"))
    base = df.groupBy(*keys).agg(
        (F.count_if(F.col(amount) % 100 == 0) / F.count(F.lit(1))).alias("round_number_bias"),
        F.count_if(unusual).alias("time_pattern_anomalies"),
    )
    top = vendor_share(df, keys, vendor, amount).groupBy(*keys).agg(F.max("share").alias("vendor_concentration_risk"))
    out = base.join(copies, keys).join(top, keys)
    return (
        out.withColumn("duplicates_found", F.col("duplicate_transactions") > 0)
        .withColumn("round_high", F.col("round_number_bias") > 0.15)
        .withColumn("time_high", F.col("time_pattern_anomalies") > 10)
        .withColumn("concentration_high", F.col("vendor_concentration_risk") > 0.6)
    )
