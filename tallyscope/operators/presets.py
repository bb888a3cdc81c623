"""Configured runs: analyses judged under every preset at once, by joining the presets as a dimension.

A preset is one row of ``config.preset_dimension``; a run under one preset keeps its rows. The
dimensions have a handful of rows, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.constants import STOPWORDS
from tallyscope.functions.scores import correlation
from tallyscope.operators import digit_law, forest, word_law
from tallyscope.operators.risk import composite


def digit_verdicts(tests: DataFrame, keys: Sequence[str], presets: DataFrame) -> DataFrame:
    """Verdict of every preset on the rows of ``digit_law.engine_test``."""
    return digit_law.configured(tests, keys, presets.withColumnRenamed("preset", "mode")).withColumnRenamed("mode", "preset")


def weighted_risk(scores: DataFrame, keys: Sequence[str], weights: DataFrame) -> DataFrame:
    """Composite score per preset over (keys, method, score); both digit positions share the weight of the digit test."""
    family = F.regexp_replace("method", "_[12]$", "")
    rows = scores.withColumn("family", family).join(F.broadcast(weights.withColumnRenamed("method", "family")), "family")
    return composite(rows, ["preset", *keys], "score", "weight")


def word_correlation(counts: DataFrame, keys: Sequence[str], presets: DataFrame) -> DataFrame:
    """Rank-frequency correlation per preset: its number of top words, with or without stopwords."""
    keys = list(keys)
    kept = {False: counts, True: counts.where(~F.col("word").isin(STOPWORDS))}
    ranks = None
    for without, table in kept.items():
        part = word_law.ranked(table, keys, "word", "count").withColumn("remove_stopwords", F.lit(without))
        ranks = part if ranks is None else ranks.unionByName(part)
    rows = ranks.join(F.broadcast(presets), "remove_stopwords").where(F.col("rank") <= F.col("top_words"))
    return rows.groupBy("preset", *keys).agg(
        F.count(F.lit(1)).alias("items_used"), F.coalesce(correlation(F.ln("frequency"), F.ln(1 / F.col("rank"))), F.lit(0.0)).alias("correlation")
    )


def column_verdicts(columns: DataFrame, presets: DataFrame) -> DataFrame:
    """Rows of ``stats.column_quality`` judged by each preset's bounds on missing values, outliers and sample."""
    missing, outliers = F.col("missing") * 100.0 / F.col("rows"), F.coalesce(F.col("outliers"), F.lit(0)) * 100.0 / F.col("rows")
    verdict = (
        F.when(F.col("rows") < F.col("minimum_sample"), "too_small").when(missing > F.col("maximum_missing"), "missing")
        .when(outliers > F.col("maximum_outliers"), "outliers").otherwise("good")
    )
    return columns.crossJoin(F.broadcast(presets)).select("preset", "column", verdict.alias("verdict"))


def confident(anomalies: DataFrame, keys: Sequence[str], confidence: str, presets: DataFrame) -> DataFrame:
    """Anomalies per preset and level that reach its least confidence; levels by its own bounds."""
    c = F.col(confidence)
    level = F.when(c >= F.col("critical"), "critical").when(c >= F.col("high"), "high").when(c >= F.col("medium"), "medium").otherwise("low")
    rows = anomalies.join(F.broadcast(presets), c >= F.col("minimum_confidence"))
    return rows.groupBy("preset", *keys, level.alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


def forest_flags(df: DataFrame, id: str, features: Sequence[str], settings: dict[str, dict]) -> DataFrame:
    """Anomalies per preset: its number of trees, flagged above its percentile. Presets with one forest share it."""
    out = None
    for trees, percentile in sorted({(s["trees"], s["percentile"]) for s in settings.values()}):
        names = [p for p, s in settings.items() if (s["trees"], s["percentile"]) == (trees, percentile)]
        scored = forest.score(df, forest.fit(df, id, features, trees), features)
        found = forest.flag(scored, 1 - percentile / 100).where("is_anomaly = 1").select(id, "score", F.explode(F.array(*map(F.lit, names))).alias("preset"))
        out = found if out is None else out.unionByName(found)
    return out
