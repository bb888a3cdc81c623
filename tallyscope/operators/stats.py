"""Descriptive statistics, data quality, trends and scaling per group."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.scores import correlation, ratio
from tallyscope.operators.ordered import scan
from tallyscope.operators.quantiles import exact_percentiles, join_stats, with_median_gap


def _number(c: str) -> Column:
    return F.col(c).cast("double")


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Fourteen measures per group; standard deviation and both moments are population forms."""
    keys, x = list(keys), _number(value)
    base = df.groupBy(*keys).agg(
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std_dev"),
        F.var_pop(x).alias("variance"),
        F.min(x).alias("min_value"),
        F.max(x).alias("max_value"),
        F.skewness(x).alias("skewness"),
        F.kurtosis(x).alias("kurtosis"),
    )
    cuts = exact_percentiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, n="count")
    out = base.join(cuts, keys) if keys else base.crossJoin(cuts)
    return (
        out.withColumn("range", F.col("max_value") - F.col("min_value"))
        .withColumn("iqr", F.col("q3") - F.col("q1"))
        .withColumn("coefficient_variation", F.coalesce(ratio(F.col("std_dev"), F.col("mean")), F.lit(0.0)))
    )


def shape_labels(described: DataFrame) -> DataFrame:
    """Symmetry and tail labels from skewness and excess kurtosis."""
    s, k = F.col("skewness"), F.col("kurtosis")
    return (
        described.withColumn("is_symmetric", F.abs(s) < 0.5)
        .withColumn(
            "skewness_label",
            F.when(F.abs(s) < 0.5, "approximately symmetric")
            .when(s > 0.5, "positively skewed (right tail)")
            .otherwise("negatively skewed (left tail)"),
        )
        .withColumn(
            "kurtosis_label",
            F.when(F.abs(k) < 0.5, "mesokurtic (normal)")
            .when(k > 0.5, "leptokurtic (heavy tails)")
            .otherwise("platykurtic (light tails)"),
        )
        .withColumn("has_heavy_tails", k > 3)
    )


def z_scores(df: DataFrame, keys: Sequence[str], value: str, sample: bool = True, out: str = "z") -> DataFrame:
    """(x - mean) / std per group; 0 where std is 0 or missing."""
    keys = list(keys)
    std = F.stddev_samp if sample else F.stddev_pop
    stats = df.groupBy(*keys).agg(F.avg(_number(value)).alias("_mean"), std(_number(value)).alias("_std"))
    z = F.when(F.col("_std") > 0, (_number(value) - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    return join_stats(df, stats, keys).withColumn(out, z).drop("_mean", "_std")


def scaled(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """Scale numeric columns over the whole table: ``standard``, ``minmax`` or ``robust``.

    Missing values count as 0. A constant column gives 0.
    """
    filled = df.na.fill(0, subset=list(columns))
    if method == "robust":
        # one row per column, each from its own exact percentiles
        out = filled
        for c in columns:
            cuts = exact_percentiles(filled, [], c, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}).drop("n")
            width = F.col("_q3") - F.col("_q1")
            out = join_stats(out, cuts, []).withColumn(
                c, (_number(c) - F.col("_q2")) / F.when(width != 0, width).otherwise(1.0)
            )
            out = out.drop("_q1", "_q2", "_q3")
        return out
    aggs = []
    for c in columns:
        if method == "standard":
            aggs += [F.avg(_number(c)).alias(f"_a_{c}"), F.stddev_pop(_number(c)).alias(f"_b_{c}")]
        elif method == "minmax":
            aggs += [F.min(_number(c)).alias(f"_a_{c}"), (F.max(_number(c)) - F.min(_number(c))).alias(f"_b_{c}")]
        else:
            raise ValueError(f"unknown scaling {method}")
    out = join_stats(filled, filled.agg(*aggs), [])
    for c in columns:
        width = F.col(f"_b_{c}")
        out = out.withColumn(c, F.when(width > 0, (_number(c) - F.col(f"_a_{c}")) / width).otherwise(0.0))
    return out.select(*df.columns)


def sample_size_verdict(n: Column, minimum: int = 30) -> tuple[Column, Column]:
    """(adequate, message) for a sample size."""
    message = (
        F.when(n < minimum, F.concat(F.lit("Sample size "), n.cast("string"), F.lit(f" below minimum required {minimum}")))
        .when(n < 100, "Sample size adequate but limited statistical power")
        .when(n < 1000, "Good sample size for statistical analysis")
        .otherwise("Excellent sample size for robust statistical analysis")
    )
    return n >= minimum, message


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def correlated_pairs(df: DataFrame, columns: Sequence[str] | None = None, bound: float = 0.9) -> DataFrame:
    """Column pairs with |correlation| above ``bound``: every pair in one aggregate pass."""
    pairs = list(combinations(columns or _numeric(df), 2))
    row = df.agg(*[correlation(_number(a), _number(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(
        *[
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.abs(f"p{i}").alias("correlation"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(F.inline(items)).where(F.col("correlation") > bound)


def column_quality(df: DataFrame) -> DataFrame:
    """One row per column: type, missing share, zero variance, outliers beyond the IQR fences."""
    names, numeric = df.columns, _numeric(df)
    first = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"miss_{c}") for c in names],
        *[F.var_samp(_number(c)).alias(f"var_{c}") for c in numeric],
    )
    types = dict(df.dtypes)
    base = first.select(
        "rows",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.lit(types[c]).alias("data_type"),
                        F.col(f"miss_{c}").alias("missing"),
                        (F.col(f"var_{c}") if c in numeric else F.lit(None).cast("double")).alias("variance"),
                    )
                    for c in names
                ]
            )
        ),
    )
    if not numeric:
        return base.withColumn("outliers", F.lit(None).cast("bigint"))
    # long form keeps all columns in one percentile job: group = column name
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _number(c).alias("x")) for c in numeric])).alias("s")
    ).select("s.*")
    cuts = exact_percentiles(long, ["column"], "x", {"q1": 0.25, "q3": 0.75}).drop("n")
    width = F.col("q3") - F.col("q1")
    beyond = (F.col("x") < F.col("q1") - 1.5 * width) | (F.col("x") > F.col("q3") + 1.5 * width)
    # few rows: one per column
    outliers = long.join(F.broadcast(cuts), "column").groupBy("column").agg(F.count_if(beyond).alias("outliers"))
    out = base.join(outliers, "column", "left")
    return out.withColumn("outliers", F.when(F.col("variance") != 0, F.col("outliers")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows (one-row result)."""
    return df.groupBy(*df.columns).count().agg(F.sum(F.col("count") - 1).alias("duplicates"))


def quality_score(df: DataFrame) -> DataFrame:
    """Overall data-quality score with its parts, one row."""
    columns = column_quality(df)
    pct = F.round(F.col("missing") / F.col("rows") * 100, 2)
    out_pct = F.round(F.col("outliers") / F.col("rows") * 100, 2)
    parts = columns.agg(
        F.max("rows").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.avg(pct).alias("avg_missing_pct"),
        F.count_if(F.col("variance") == 0).alias("zero_variance_columns"),
        F.coalesce(F.avg(out_pct), F.lit(0.0)).alias("avg_outlier_pct"),
    )
    all_parts = parts.crossJoin(duplicate_rows(df))
    score = (
        1
        - F.col("avg_missing_pct") / 100 * 0.3
        - F.col("duplicates") / F.col("total_rows") * 0.2
        - F.col("zero_variance_columns") / F.col("total_columns") * 0.2
        - F.when(F.col("avg_outlier_pct") > 10, (F.col("avg_outlier_pct") - 10) / 100 * 0.3).otherwise(0.0)
    )
    return all_parts.withColumn("overall_quality_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def amount_text_quality(amounts: DataFrame, texts: DataFrame, keys: Sequence[str], amount: str, text: str) -> DataFrame:
    """Amount and text quality per group with the combined score (mean of the parts present)."""
    keys = list(keys)
    x = _number(amount)
    fin = amounts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.min(x).alias("min_amount"),
        F.max(x).alias("max_amount"),
        F.avg(x).alias("mean_amount"),
        F.count_if(x == 0).alias("zero_amounts"),
        F.count_if(x < 0).alias("negative_amounts"),
    )
    tokens = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    txt = texts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("text_entries"),
        F.sum(tokens).alias("total_words"),
        F.count_if(F.trim(text) == "").alias("empty_entries"),
    )
    out = fin.join(txt, keys, "full") if keys else fin.crossJoin(txt)
    adequate, message = sample_size_verdict(F.col("sample_size"))
    fin_score = (
        F.when(F.col("sample_size").isNull(), F.lit(None))
        .otherwise(F.when(adequate, 1.0).otherwise(0.5) * F.when(F.col("zero_amounts") > 0, 0.9).otherwise(1.0))
    )
    text_score = F.least(F.col("total_words") / 100, F.lit(1.0))
    both = F.filter(F.array(fin_score, text_score), lambda v: v.isNotNull())
    mean = F.aggregate(both, F.lit(0.0), lambda s, v: s + v) / F.size(both)
    return (
        out.withColumn("sample_size_adequate", adequate)
        .withColumn("sample_size_message", message)
        .withColumn("overall_quality_score", F.when(F.size(both) > 0, mean).otherwise(0.0))
    )


def trend(df: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """Least-squares slope over position, volatility, latest value, range and trend risk."""
    x, y = _number(position), _number(value)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("trend_slope"),
        F.stddev_pop(y).alias("volatility"),
        F.max_by(y, x).alias("latest_score"),
        (F.max(y) - F.min(y)).alias("score_range"),
    )
    slope = F.col("trend_slope")
    return out.withColumn(
        "trend_direction",
        F.when(F.col("n") < 2, "insufficient_data")
        .when(F.abs(slope) < 0.01, "stable")
        .when(slope > 0, "increasing")
        .otherwise("decreasing"),
    ).withColumn("trend_risk", F.when(F.col("n") < 2, 0.0).otherwise(F.least(F.greatest(slope * 2, F.lit(0.0)), F.lit(0.3))))


def returns(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Simple returns against the previous value of the series; the first row has none."""
    out = scan(df, keys, order, previous={"_before": value})
    return out.withColumn("r", ratio(_number(value) - _number("_before"), _number("_before"))).drop("_before")


def return_risk(with_returns: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Volatility, downside deviation, Sharpe ratio, values at risk, coefficient of variation."""
    keys = list(keys)
    r, x = F.col("r"), _number(value)
    base = with_returns.groupBy(*keys).agg(
        F.stddev_pop(r).alias("volatility"),
        F.coalesce(F.stddev_pop(F.when(r < 0, r)), F.lit(0.0)).alias("downside_deviation"),
        F.avg(r).alias("_mean"),
        F.stddev_pop(x).alias("_sd"),
        F.avg(x).alias("_mx"),
    )
    var = exact_percentiles(with_returns, keys, "r", {"value_at_risk_95": 0.05, "value_at_risk_99": 0.01}).drop("n")
    out = base.join(var, keys) if keys else base.crossJoin(var)
    return (
        out.withColumn("sharpe_ratio", F.coalesce(ratio(F.col("_mean"), F.col("volatility")), F.lit(0.0)))
        .withColumn("coefficient_of_variation", ratio(F.col("_sd"), F.col("_mx")))
        .drop("_mean", "_sd", "_mx")
    )


def value_at_risk(df: DataFrame, keys: Sequence[str], returns_col: str, confidence: float = 0.95) -> DataFrame:
    return exact_percentiles(df, keys, returns_col, {"value_at_risk": 1 - confidence})


def max_drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Deepest fall of the cumulative return curve, which starts after the first return.

    The product of returns telescopes to x / x0, so the running peak of x is enough.
    """
    keys = list(keys)
    numbered = scan(df.withColumn("_x", _number(value)), keys, order, number="_i")
    later = numbered.where(F.col("_i") > 1)
    curve = scan(later, keys, order, maxes={"_peak": "_x"})
    return curve.groupBy(*keys).agg(F.min(ratio(F.col("_x") - F.col("_peak"), F.col("_peak"))).alias("max_drawdown"))


def percentile_interval(df: DataFrame, keys: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    a = 1 - level
    return exact_percentiles(df, keys, value, {"lower": a / 2, "upper": 1 - a / 2})


BAND_CUTS = {"c25": 0.25, "c50": 0.5, "c75": 0.75, "c90": 0.9, "c95": 0.95, "c100": 1.0}


def percentile_band(x: Column) -> Column:
    """Band 0..5 of a value against the ``BAND_CUTS`` columns."""
    band = F.lit(6)
    for i, name in reversed(list(enumerate(BAND_CUTS))):
        band = F.when(x <= F.col(name), i).otherwise(band)
    return band


def deviation_band(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """|x - mean| / mean and the percentile band 0..5 of each row."""
    keys = list(keys)
    cuts = exact_percentiles(df, keys, value, BAND_CUTS).drop("n")
    means = df.groupBy(*keys).agg(F.avg(_number(value)).alias("_mean"))
    stats = cuts.join(means, keys) if keys else cuts.crossJoin(means)
    x = _number(value)
    out = join_stats(df, stats, keys)
    return (
        out.withColumn("deviation", F.coalesce(ratio(F.abs(x - F.col("_mean")), F.col("_mean")), F.lit(0.0)))
        .withColumn("band", percentile_band(x))
        .drop("_mean", *BAND_CUTS)
    )


def jarque_bera(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Normality from the moments: n/6 (s^2 + k^2/4), with its exact two-dof p-value."""
    x = _number(value)
    out = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis")
    )
    stat = F.col("n") / 6 * (F.pow("skewness", F.lit(2.0)) + F.pow("kurtosis", F.lit(2.0)) / 4)
    return out.withColumn("jarque_bera", stat).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """Kolmogorov-Smirnov test against the normal fitted with population std (needs 20 values).

    The empirical ranks come from the ordered scan, the distance from one aggregate.
    """
    base = df.select(_number(value).alias("x")).where(F.col("x").isNotNull())
    # equal values collapse to one row with a count, so ties need no further order key
    counted = base.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    ordered = scan(counted, [], [F.col("x")], sums={"upto": "c"})
    stats = base.agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"), F.count("x").alias("n"))
    rows = join_stats(ordered, stats, [])
    cdf = _normal_cdf((F.col("x") - F.col("mu")) / F.col("sd"))
    above, below = F.col("upto") / F.col("n") - F.col("cdf"), F.col("cdf") - (F.col("upto") - F.col("c")) / F.col("n")
    out = rows.withColumn("cdf", cdf).agg(F.max("n").alias("n"), F.max(F.greatest(above, below)).alias("ks_statistic"))
    t = F.sqrt("n") * F.col("ks_statistic")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * t * t),
    )
    p = F.when(t < 0.2, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))
    return out.where(F.col("n") >= 20).withColumn("p_value", p).withColumn("is_normal", F.col("p_value") > 0.05)


def _normal_cdf(z: Column) -> Column:
    """Standard normal distribution; ``erf`` is not a Spark built-in, so an Arrow function over whole batches.

    Sums the series of positive terms z^(2k+1) / (1 * 3 * ... * (2k+1)); beyond 8 deviations the
    distribution is 0 or 1 to double precision.
    """
    @F.pandas_udf("double")
    def cdf(s: pd.Series) -> pd.Series:
        z = s.to_numpy(float)
        a = np.minimum(np.abs(z), 8.0)
        term, total = a.copy(), a.copy()
        for k in range(1, 151):
            term = term * a * a / (2 * k + 1)
            total += term
        return pd.Series(0.5 + np.sign(z) * total * np.exp(-a * a / 2) / np.sqrt(2 * np.pi))

    return cdf(z)


def median_gap(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return with_median_gap(df, keys, value)
