"""First-, second- and two-digit law tests per group.

All tests count (group, digit) first. At most 90 rows per group cross the shuffle and all
further work runs on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.constants import CHI2_CRITICAL, DIGIT_ADVICE, ENGINE_CRITICAL
from tallyscope.functions.chi2 import critical_value, p_value, step_p_value
from tallyscope.functions.digits import digit_pair, integer_digit, leading_two, significant_digit


def law(n: Column) -> Column:
    return F.log10(1 + 1 / n)


def expected_digits(spark: SparkSession, position: int | str = 1) -> DataFrame:
    """Dimension (digit, expected): position 1, 2 or ``"pair"`` (10..99)."""
    first, stop = {1: (1, 10), 2: (0, 10), "pair": (10, 100)}[position]
    digits = spark.range(first, stop, numPartitions=1).select(F.col("id").cast("int").alias("digit"))
    if position == 2:
        tens = F.sequence(F.lit(1), F.lit(9))
        expr = F.aggregate(tens, F.lit(0.0), lambda s, t: s + law(t * 10 + F.col("digit")))
    else:
        expr = law(F.col("digit"))
    return digits.withColumn("expected", expr)


def conditional_expected(spark: SparkSession, form: str = "exact") -> DataFrame:
    """Second digit given the first (d1, digit, expected), 90 rows.

    ``exact`` is the law's conditional share and sums to 1 per first digit. ``reference``
    is the published tool's formula, which does not.
    """
    grid = spark.range(10, 100, numPartitions=1).select(
        F.floor(F.col("id") / 10).cast("int").alias("d1"), (F.col("id") % 10).cast("int").alias("digit")
    )
    pair = F.col("d1") * 10 + F.col("digit")
    if form == "exact":
        return grid.withColumn("expected", law(pair) / law(F.col("d1")))
    hundreds = F.sequence(F.lit(0), F.lit(9))
    total = F.aggregate(hundreds, F.lit(0.0), lambda s, k: s + law(pair + k * 100))
    return grid.withColumn("expected", total / F.col("d1"))


def digit_counts(df: DataFrame, keys: Sequence[str], digit: Column) -> DataFrame:
    """(keys, digit, n) of the rows that have a digit."""
    return df.select(*keys, digit.alias("digit")).where(F.col("digit").isNotNull()).groupBy(*keys, "digit").agg(
        F.count(F.lit(1)).alias("n")
    )


def digit_table(counts: DataFrame, keys: Sequence[str], expected: DataFrame) -> DataFrame:
    """Observed and expected share for every digit of every group, zero where absent.

    The total includes digits outside the expected classes (digit 0 of values below 1).
    """
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    frame = totals.crossJoin(F.broadcast(expected))
    table = frame.join(counts, [*keys, "digit"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return table.select(
        *keys,
        "digit",
        "n",
        "total",
        (F.col("n") / F.col("total")).alias("observed"),
        "expected",
        (F.col("n") / F.col("total") - F.col("expected")).alias("deviation"),
    )


def _chi2_term(floor: float = 0.0) -> Column:
    want = F.col("expected") * F.col("total")
    want = F.greatest(want, F.lit(floor)) if floor else want
    return F.pow(F.col("n") - want, 2) / want


def configured(tests: DataFrame, keys: Sequence[str], modes: DataFrame) -> DataFrame:
    """Verdict of every mode on the rows of ``engine_test``: significant, not significant, or too few values.

    ``modes`` is ``config.digit_dimension``; a configured run keeps the rows of its mode.
    """
    enough = F.col("sample_size") >= F.col("minimum_sample")
    verdict = F.when(~enough, "insufficient").when(F.col("chi_square") > F.col("mode_critical"), "significant").otherwise("conforming")
    return tests.crossJoin(F.broadcast(modes)).select(*keys, "mode", "sample_size", "chi_square", "mode_critical", verdict.alias("verdict"))


def engine_test(
    df: DataFrame, keys: Sequence[str], value: str, position: int = 1, critical: str = "dof", confidence: float = 0.95
) -> DataFrame:
    """Digit test with coarse p-value, risk score and anomalous digits, one row per group.

    ``critical="dof"`` uses the value of the position's degrees of freedom, from the table or,
    for other confidences, computed. ``"reference"`` uses 15.51 (20.09) at both positions.
    """
    keys = list(keys)
    if critical == "reference":
        bound = ENGINE_CRITICAL[confidence]
    else:
        dof = 8 if position == 1 else 9
        bound = CHI2_CRITICAL.get((dof, confidence)) or critical_value(dof, confidence)
    spark = df.sparkSession
    counts = digit_counts(df, keys, integer_digit(F.col(value), position))
    table = digit_table(counts, keys, expected_digits(spark, position))
    shares = [
        F.max(F.when(F.col("digit") == d, F.col("observed"))).alias(f"share_{d}") for d in (1, 2, 3, 5)
    ]
    odd = F.sort_array(F.collect_list(F.when(F.abs("deviation") > 0.05, F.col("digit"))))  # at most ten digits
    out = table.groupBy(*keys).agg(
        F.sum(_chi2_term()).alias("chi_square"), F.max("total").alias("sample_size"), odd.alias("anomalous"), *shares
    )
    return out.select(
        *keys,
        F.lit(position).alias("digit_position"),
        "sample_size",
        "chi_square",
        step_p_value(F.col("chi_square")).alias("p_value"),
        F.lit(bound).alias("critical_value"),
        (F.col("chi_square") > bound).alias("is_significant"),
        F.least(F.col("chi_square") / (2 * bound), F.lit(1.0)).alias("risk_score"),
        F.col("anomalous").alias("anomalous_digits"),
        *[f"share_{d}" for d in (1, 2, 3, 5)],
    )


def newcomb(result: DataFrame) -> DataFrame:
    """First-digit result with the round-number and preference additions to the risk."""
    rounding = (F.col("share_1") > 0.35) | (F.col("share_5") > 0.12)
    liking = (F.col("share_2") > 0.20) | (F.col("share_3") > 0.15)
    after_round = F.when(rounding, F.least(F.col("risk_score") + 0.1, F.lit(1.0))).otherwise(F.col("risk_score"))
    out = result.withColumn("risk_score", after_round)
    out = out.withColumn(
        "risk_score",
        F.when(liking, F.least(F.col("risk_score") + 0.05, F.lit(1.0))).otherwise(F.col("risk_score")),
    )
    return out.withColumn("round_number_bias", rounding).withColumn("number_preference", liking)


def manipulation_patterns(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Named patterns per group from a first-digit table."""
    share = {d: F.max(F.when(F.col("digit") == d, F.col("observed"))) for d in (1, 2, 3, 5)}
    low = F.sort_array(
        F.collect_list(F.when((F.col("observed") < 0.02) & F.col("digit").isin(7, 8, 9), F.col("digit").cast("string")))
    )
    out = table.groupBy(*keys).agg(
        *[c.alias(f"s{d}") for d, c in share.items()],
        low.alias("low"),
        (F.stddev_pop("observed") / F.avg("observed")).alias("cv"),
    )
    return out.select(
        *keys,
        (F.col("s1") > 0.35).alias("excess_1"),
        (F.col("s5") > 0.12).alias("excess_5"),
        (F.col("s2") > 0.20).alias("excess_2"),
        (F.col("s3") > 0.15).alias("excess_3"),
        F.array_join("low", ",").alias("avoided_digits"),
        (F.col("cv") < 0.3).alias("too_uniform"),
    )


def grade(p: Column, levels: int = 4) -> Column:
    """Conformity from a p-value: four grades, or three without ``acceptable``."""
    if levels == 4:
        return F.when(p > 0.1, "good").when(p > 0.05, "acceptable").when(p > 0.01, "questionable").otherwise("poor")
    return F.when(p > 0.05, "good").when(p > 0.01, "questionable").otherwise("poor")


def significant_table(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    counts = digit_counts(df, keys, significant_digit(F.col(value)))
    return digit_table(counts, keys, expected_digits(df.sparkSession, 1))


def significant_test(df: DataFrame, keys: Sequence[str], value: str, min_values: int = 10, levels: int = 4) -> DataFrame:
    """First-significant-digit analysis: chi-square, exact p, KS, MAD, grades, odd digits."""
    keys = list(keys)
    table = significant_table(df, keys, value).where(F.col("total") >= min_values)
    by_digit = Window.partitionBy(*keys).orderBy("digit")  # nine rows per group
    table = table.withColumn("_gap", F.abs(F.sum("observed").over(by_digit) - F.sum("expected").over(by_digit)))
    out = table.groupBy(*keys).agg(
        F.max("total").alias("total_values"),
        F.sum(_chi2_term(0.5)).alias("chi_square"),
        F.max("_gap").alias("ks_statistic"),
        F.avg(F.abs("deviation")).alias("mean_absolute_deviation"),
        F.sum(F.abs("deviation")).alias("deviation_score"),
        F.count_if(F.abs("deviation") > 0.02).alias("anomalous_digits"),
    )
    out = out.withColumn("p_value", p_value(F.col("chi_square"), 8))
    # the published p-value counts the nine classes; the sample one counts values
    out = out.withColumn("ks_p_value", 2 * F.exp(-18 * F.pow("ks_statistic", F.lit(2.0))))
    out = out.withColumn(
        "ks_p_value_sample", F.least(2 * F.exp(-2 * F.col("total_values") * F.pow("ks_statistic", F.lit(2.0))), F.lit(1.0))
    )
    return out.withColumn("significant", F.col("p_value") < 0.05).withColumn("conformity", grade(F.col("p_value"), levels))


def anomalous_digits(table: DataFrame, keys: Sequence[str], bound: float = 0.02) -> DataFrame:
    """Digits that deviate by more than ``bound``, with their rank by deviation."""
    w = Window.partitionBy(*keys).orderBy(F.round(F.abs("deviation"), 9).desc(), "digit")
    return table.where(F.abs("deviation") > bound).select(
        *keys,
        "digit",
        "observed",
        "expected",
        F.abs("deviation").alias("deviation"),
        (F.abs("deviation") / F.col("expected") * 100).alias("deviation_percentage"),
        F.row_number().over(w).cast("bigint").alias("rank"),
    )


def second_digit_test(
    df: DataFrame, keys: Sequence[str], value: str, min_samples: int = 5, form: str = "exact"
) -> DataFrame:
    """Conditional second-digit test, one row per (group, first digit) with enough samples."""
    keys = list(keys)
    pairs = df.select(*keys, digit_pair(F.col(value)).alias("p")).where(F.col("p").isNotNull())
    counts = pairs.groupBy(*keys, F.col("p.d1").alias("d1"), F.col("p.d2").alias("digit")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy(*keys, "d1").agg(F.sum("n").alias("total")).where(F.col("total") >= min_samples)
    frame = totals.join(F.broadcast(conditional_expected(df.sparkSession, form)), "d1")
    table = frame.join(counts, [*keys, "d1", "digit"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = table.groupBy(*keys, "d1").agg(F.max("total").alias("sample_size"), F.sum(_chi2_term(0.5)).alias("chi_square"))
    out = out.withColumn("p_value", p_value(F.col("chi_square"), 9))
    return out.withColumn("conformity", grade(F.col("p_value")))


def second_digit_overall(result: DataFrame, keys: Sequence[str]) -> DataFrame:
    score = (
        F.when(F.col("conformity") == "good", 3)
        .when(F.col("conformity") == "acceptable", 2)
        .when(F.col("conformity") == "questionable", 1)
        .otherwise(0)
    )
    out = result.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("digits_tested"), F.avg(score).alias("mean_score"), F.avg("p_value").alias("mean_p")
    )
    label = (
        F.when(F.col("mean_score") >= 2.5, "good")
        .when(F.col("mean_score") >= 1.5, "acceptable")
        .when(F.col("mean_score") >= 0.5, "questionable")
        .otherwise("poor")
    )
    return out.withColumn("overall_conformity", label)


def comprehensive(df: DataFrame, keys: Sequence[str], value: str, form: str = "exact") -> DataFrame:
    """Overall compliance: 0.7 * (1 - deviation score) + 0.3 * mean second-digit p-value."""
    keys = list(keys)
    first = significant_test(df, keys, value).select(*keys, "deviation_score", "conformity")
    second = second_digit_overall(second_digit_test(df, keys, value, form=form), keys)
    both = first.join(second, keys, "left") if keys else first.crossJoin(second)
    score = 0.7 * (1 - F.col("deviation_score")) + 0.3 * F.coalesce("mean_p", F.lit(0.0))
    both = both.withColumn("overall_compliance_score", score)
    label = (
        F.when(F.col("overall_compliance_score") >= 0.8, "high_compliance")
        .when(F.col("overall_compliance_score") >= 0.6, "moderate_compliance")
        .when(F.col("overall_compliance_score") >= 0.4, "low_compliance")
        .otherwise("poor_compliance")
    )
    return both.withColumn("assessment", label)


def digit_advice(df: DataFrame, keys: Sequence[str], value: str, form: str = "exact") -> DataFrame:
    """Advice texts per group from the first- and second-digit results."""
    keys = list(keys)
    first = significant_test(df, keys, value).select(*keys, "significant")
    worst = anomalous_digits(significant_table(df, keys, value), keys).where(F.col("rank") == 1)
    worst = worst.select(*keys, F.col("digit").alias("_digit"), "deviation_percentage")
    second = second_digit_overall(second_digit_test(df, keys, value, form=form), keys).select(*keys, "overall_conformity")
    rows = first.join(worst, keys, "left").join(second, keys, "left")
    top = F.concat(
        F.lit("Digit "), F.col("_digit").cast("string"), F.lit(" shows highest deviation ("), F.format_string("%.1f", "deviation_percentage"), F.lit("%)")
    )
    one = F.when(F.col("significant") & F.col("_digit").isNotNull(), top)
    texts = F.filter(
        F.array(
            F.when(F.col("significant"), DIGIT_ADVICE["first"]),
            one,
            F.when(F.coalesce("overall_conformity", F.lit("poor")).isin("questionable", "poor"), DIGIT_ADVICE["second"]),
        ),
        lambda t: t.isNotNull(),
    )
    more = F.array(*[F.lit(t) for t in DIGIT_ADVICE["follow_up"]])
    done = F.when(F.size(texts) > 0, F.concat(texts, more)).otherwise(F.array(F.lit(DIGIT_ADVICE["clear"])))
    return rows.select(*keys, done.alias("recommendations"))


def two_digit_test(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Test over the 90 classes 10..99 of the leading two digits."""
    keys = list(keys)
    counts = digit_counts(df, keys, leading_two(F.col(value)))
    table = digit_table(counts, keys, expected_digits(df.sparkSession, "pair"))
    return table.groupBy(*keys).agg(
        F.max("total").alias("sample_size"),
        F.sum(_chi2_term()).alias("chi_square"),
        F.avg(F.abs("deviation")).alias("mean_absolute_deviation"),
        F.count_if(F.col("n") == 0).alias("empty_classes"),
    )
