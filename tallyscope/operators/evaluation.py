"""Detector evaluation: confusion counts, AUC, cost-weighted reward, score statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.constants import REWARD
from tallyscope.operators.ordered import down, scan
from tallyscope.session import reliable


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def confusion(df: DataFrame, keys: Sequence[str], predicted: str, label: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 with zero guards, and the total reward."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    out = df.groupBy(*keys).agg(
        F.count_if(p & y).alias("tp"),
        F.count_if(~p & ~y).alias("tn"),
        F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"),
    )
    precision = _zero(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")))
    recall = _zero(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))
    out = out.withColumn("precision", precision).withColumn("recall", recall)
    f1 = _zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("f1_score", f1).withColumn("total_reward", sum((F.col(k) * v for k, v in REWARD.items()), F.lit(0)))


def threshold_sweep(df: DataFrame, keys: Sequence[str], score: str, label: str, grid: Sequence[float]) -> DataFrame:
    """Reward at each threshold of the grid, all in one aggregate pass."""
    s, y = F.col(score), F.col(label) == 1
    sums = []
    for i, t in enumerate(grid):
        flagged = s >= t
        gain = (
            F.when(flagged & y, REWARD["tp"]).when(~flagged & ~y, REWARD["tn"]).when(flagged & ~y, REWARD["fp"]).otherwise(REWARD["fn"])
        )
        sums.append(F.sum(gain).alias(f"g{i}"))
    wide = df.groupBy(*keys).agg(*sums)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"g{i}").alias("total_reward")) for i, t in enumerate(grid)])
    return wide.select(*keys, F.inline(rows))


def auc(df: DataFrame, keys: Sequence[str], score: str, label: str, high_is_positive: bool = True) -> DataFrame:
    """Area under the ROC curve by ranks; equal scores count half.

    Scores are counted first, so only distinct scores are ordered. Pass
    ``high_is_positive=False`` for a score whose high end is normal.
    """
    keys = list(keys)
    y = F.col(label) == 1
    counts = reliable(df.groupBy(*keys, score).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_n")))
    order = F.col(score) if high_is_positive else down(F.col(score))
    rows = scan(counts, keys, [order], sums={"_below": "_n"})
    won = F.col("_p") * (F.col("_below") - F.col("_n") + 0.5 * F.col("_n"))
    out = rows.groupBy(*keys).agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), F.sum(won).alias("_won"))
    value = F.try_divide(F.col("_won"), (F.col("positives") * F.col("negatives")).cast("double"))
    return out.withColumn("auc", value).drop("_won")


def score_statistics(df: DataFrame, keys: Sequence[str], predicted: str, score: str) -> DataFrame:
    """Anomaly rate, means by predicted class, separation, extremes and population std."""
    p, s = F.col(predicted) == 1, F.col(score)
    out = df.groupBy(*keys).agg(
        F.avg(p.cast("double")).alias("anomaly_rate"),
        F.avg(F.when(p, s)).alias("_a"),
        F.avg(F.when(~p, s)).alias("_n"),
        F.max(s).alias("max_score"),
        F.min(s).alias("min_score"),
        F.stddev_pop(s).alias("score_std"),
    )
    return (
        out.withColumn("mean_anomaly_score", _zero(F.col("_a")))
        .withColumn("mean_normal_score", _zero(F.col("_n")))
        .withColumn("score_separation", _zero(F.col("_a") - F.col("_n")))
        .drop("_a", "_n")
    )


def metrics_long(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model-by-metric long list from one wide row per model."""
    names = [c for c in metrics.columns if c not in keys]
    wide = metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot(list(keys), names, "metric", "value")


def decision_summary(df: DataFrame, keys: Sequence[str], flagged: str, reward: str) -> DataFrame:
    """Flag rate, mean reward, convergence and adaptive threshold 0.5 + 0.3 * convergence."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(flagged) == 1).alias("total_flags"),
        F.avg((F.col(flagged) == 1).cast("double")).alias("flag_rate"),
        F.avg(reward).alias("average_reward"),
    )
    convergence = F.least(F.abs("average_reward"), F.lit(1.0))
    return out.withColumn("convergence", convergence).withColumn("adaptive_threshold", 0.5 + convergence * 0.3)
