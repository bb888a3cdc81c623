"""Digit-law and word-law queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions import digits as dg
from tallyscope.functions.scores import risk_level
from tallyscope.functions.text import words
from tallyscope.operators import digit_law as dl
from tallyscope.operators import word_law as wl
from tallyscope.plans import views as v
from tallyscope.plans.catalog.ledgers import r
from tallyscope.plans.catalog.measures import rounded
from tallyscope.plans.registry import query


@query(
    "f1_digit_forms",
    """
    WITH x AS (SELECT id, amount, CAST(CAST(trunc(abs(amount)) AS BIGINT) AS VARCHAR) AS i,
                      CAST(CAST(abs(amount) AS DECIMAL(28,10)) AS VARCHAR) AS t FROM activity WHERE amount <> 0)
    SELECT id, CAST(left(i, 1) AS INTEGER) AS integer_digit, CAST(CASE WHEN length(i) >= 2 THEN substr(i, 2, 1) END AS DOUBLE) AS second_digit,
           CAST(regexp_extract(t, '[1-9]') AS INTEGER) AS significant_digit,
           CASE WHEN left(t, 1) <> '0' THEN left(replace(t, '.', ''), 2) END AS pair,
           CAST(CASE WHEN length(i) >= 2 THEN left(i, 2) END AS DOUBLE) AS leading_two,
           CAST(left(CAST(CAST(amount AS DECIMAL(20,2)) AS VARCHAR), 1) AS INTEGER) AS text_digit
    FROM x
    """,
    ["activity"],
)
def f1(spark, d):
    x = F.col("amount")
    pair = dg.digit_pair(x)
    return v.activity(spark, d).where(x != 0).select(
        "id",
        dg.integer_digit(x).alias("integer_digit"),
        dg.integer_digit(x, 2).cast("double").alias("second_digit"),
        dg.significant_digit(x).alias("significant_digit"),
        F.concat(pair["d1"].cast("string"), pair["d2"].cast("string")).alias("pair"),
        dg.leading_two(x).cast("double").alias("leading_two"),
        dg.text_digit(x.cast(v.MONEY)).alias("text_digit"),
    )


PLAIN_TEXT = "CAST(CAST(abs(amount) AS DECIMAL(28,10)) AS VARCHAR)"
WHOLE_TEXT = "CAST(CAST(trunc(abs(amount)) AS BIGINT) AS VARCHAR)"


@query("f2_significant_digit", f"SELECT category, CAST(regexp_extract({PLAIN_TEXT}, '[1-9]') AS INTEGER) AS digit, count(*) AS n FROM activity WHERE amount <> 0 GROUP BY ALL", ["activity"])
def f2(spark, d):
    return dl.digit_counts(v.activity(spark, d), ["category"], dg.significant_digit(F.col("amount")))


@query(
    "f3_second_digit",
    f"SELECT category, CAST(substr({WHOLE_TEXT}, 2, 1) AS INTEGER) AS digit, count(*) AS n FROM activity WHERE amount <> 0 AND length({WHOLE_TEXT}) >= 2 GROUP BY ALL",
    ["activity"],
)
def f3(spark, d):
    return dl.digit_counts(v.activity(spark, d), ["category"], dg.integer_digit(F.col("amount"), 2))


@query(
    "f4_digit_pairs",
    f"SELECT category, left(replace({PLAIN_TEXT}, '.', ''), 2) AS pair, count(*) AS n FROM activity WHERE amount <> 0 AND left({PLAIN_TEXT}, 1) <> '0' GROUP BY ALL",
    ["activity"],
)
def f4(spark, d):
    rows = v.activity(spark, d).select("category", dg.digit_pair(F.col("amount")).alias("p")).where(F.col("p").isNotNull())
    return rows.groupBy("category", F.concat(F.col("p.d1").cast("string"), F.col("p.d2").cast("string")).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@query("f5_text_digit", "SELECT account_code, CAST(left(CAST(amount AS VARCHAR), 1) AS INTEGER) AS digit, count(*) AS n FROM ledger GROUP BY ALL", ["ledger"])
def f5(spark, d):
    return dl.digit_counts(v.ledger(spark, d, "account_code", "amount"), ["account_code"], dg.text_digit(F.col("amount")))


def _digit_table_sql(source, key, digit, dims):
    """CTEs c (counts) and t (digit table) for a digit expression and its dimension."""
    return f"""
    dim AS ({dims}),
    c AS (SELECT {key}, {digit} AS digit, count(*) AS n FROM {source} GROUP BY 1, 2),
    tot AS (SELECT {key}, sum(n) AS total FROM c WHERE digit IS NOT NULL GROUP BY 1),
    t AS (SELECT tot.{key}, dim.digit, coalesce(n, 0) AS n, total, coalesce(n, 0) / CAST(total AS DOUBLE) AS observed, expected,
                 coalesce(n, 0) / CAST(total AS DOUBLE) - expected AS deviation
          FROM tot CROSS JOIN dim LEFT JOIN c ON c.{key} = tot.{key} AND c.digit = dim.digit)
    """


FIRST = "SELECT CAST(range AS INTEGER) AS digit, log10(1 + 1.0::DOUBLE / range) AS expected FROM range(1, 10)"
SECOND = (
    "SELECT CAST(a.range AS INTEGER) AS digit, sum(log10(1 + 1.0::DOUBLE / (10 * b.range + a.range))) AS expected "
    "FROM range(0, 10) a, range(1, 10) b GROUP BY 1"
)
PAIRS = "SELECT CAST(range AS INTEGER) AS digit, log10(1 + 1.0::DOUBLE / range) AS expected FROM range(10, 100)"
NONZERO = "(SELECT * FROM activity WHERE amount <> 0)"
INT_TEXT = "CAST(CAST(trunc(abs(amount)) AS BIGINT) AS VARCHAR)"
D1 = f"CAST(left({INT_TEXT}, 1) AS INTEGER)"
D2 = f"CAST(CASE WHEN length({INT_TEXT}) >= 2 THEN substr({INT_TEXT}, 2, 1) END AS INTEGER)"
SIG = "CAST(regexp_extract(CAST(CAST(abs(amount) AS DECIMAL(28,10)) AS VARCHAR), '[1-9]') AS INTEGER)"
LEAD2 = f"CAST(CASE WHEN length({INT_TEXT}) >= 2 THEN left({INT_TEXT}, 2) END AS INTEGER)"


@query(
    "b1_expected_digits",
    f"WITH {_digit_table_sql(NONZERO, 'category', D1, FIRST)} SELECT category, digit, CAST(n AS BIGINT) AS n, round(expected, 9) AS expected, "
    "round(expected * total, 6) AS expected_count FROM t",
    ["activity"],
)
def b1(spark, d):
    t = _first_table(spark, d)
    return t.select("category", "digit", "n", r("expected", 9).alias("expected"), r(F.col("expected") * F.col("total")).alias("expected_count"))


def _first_table(spark, d):
    counts = dl.digit_counts(v.activity(spark, d), ["category"], dg.integer_digit(F.col("amount")))
    return dl.digit_table(counts, ["category"], dl.expected_digits(spark, 1))


@query(
    "j7_completed_digits",
    f"WITH {_digit_table_sql('ledger', 'account_code', D1, FIRST)} SELECT account_code, digit, CAST(n AS BIGINT) AS n, round(observed, 9) AS observed, round(deviation, 9) AS deviation FROM t",
    ["ledger"],
)
def j7(spark, d):
    counts = dl.digit_counts(v.ledger(spark, d, "account_code", "amount"), ["account_code"], dg.integer_digit(F.col("amount")))
    t = dl.digit_table(counts, ["account_code"], dl.expected_digits(spark, 1))
    return t.select("account_code", "digit", "n", r("observed", 9).alias("observed"), r("deviation", 9).alias("deviation"))


def _engine_sql(source, key, digit, dims, position, bound=15.507):
    return f"""
    WITH {_digit_table_sql(source, key, digit, dims)},
    x AS (SELECT {key}, sum(pow(n - expected * total, 2) / (expected * total)) AS chi, max(total) AS total,
                 string_agg(CASE WHEN abs(deviation) > 0.05 THEN CAST(digit AS VARCHAR) END, ',' ORDER BY digit) AS odd FROM t GROUP BY 1)
    SELECT {key}, {position} AS digit_position, CAST(total AS BIGINT) AS sample_size, round(chi, 4) AS chi_square,
           CASE WHEN chi > 20 THEN 0.001 WHEN chi > 15 THEN 0.05 WHEN chi > 10 THEN 0.1 ELSE 0.5 END::DOUBLE AS p_value,
           {bound}::DOUBLE AS critical_value, chi > {bound} AS is_significant, round(least(chi / (2 * {bound}), 1), 6) AS risk_score,
           coalesce(odd, '') AS anomalous_digits,
           CASE WHEN least(chi / (2 * {bound}), 1) >= 0.9 THEN 'critical' WHEN least(chi / (2 * {bound}), 1) >= 0.8 THEN 'high' WHEN least(chi / (2 * {bound}), 1) >= 0.6 THEN 'medium' ELSE 'low' END AS risk_level
    FROM x
    """


def _engine(df, keys, position=1, **options):
    out = dl.engine_test(df, keys, "amount", position, **options)
    out = out.withColumn("risk_level", risk_level(F.col("risk_score")))
    return out.select(*keys, "digit_position", "sample_size", r("chi_square", 4).alias("chi_square"), F.col("p_value").cast("double").alias("p_value"),
                      "critical_value", "is_significant", r("risk_score").alias("risk_score"), F.array_join("anomalous_digits", ",").alias("anomalous_digits"), "risk_level")


@query("b2_benford_first_digit", _engine_sql(NONZERO, "category", D1, FIRST, 1), ["activity"])
def b2(spark, d):
    return _engine(v.activity(spark, d), ["category"])


@query("b2_benford_second_digit", _engine_sql(NONZERO, "category", D2, SECOND, 2, 16.919), ["activity"])
def b2_second(spark, d):
    return _engine(v.activity(spark, d), ["category"], 2)


@query("b2_benford_reference", _engine_sql(NONZERO, "category", D2, SECOND, 2, 15.51), ["activity"])
def b2_reference(spark, d):
    return _engine(v.activity(spark, d), ["category"], 2, critical="reference")


@query(
    "d1_configured_digits",
    f"""WITH {_digit_table_sql('activity', 'account_id', D1, FIRST)},
    x AS (SELECT account_id, sum(pow(n - expected * total, 2) / (expected * total)) AS chi, CAST(max(total) AS BIGINT) AS total FROM t GROUP BY 1),
    p(mode, bound, least) AS (VALUES ('standard', 15.507313056, 30), ('custom', 15.507313056, 30), ('conservative', 20.09023503, 50), ('aggressive', 13.361566137, 20))
    SELECT account_id, mode, CASE WHEN total < least THEN 'insufficient' WHEN chi > bound THEN 'significant' ELSE 'conforming' END AS verdict FROM x, p""",
    ["activity"],
)
def d1_digits(spark, d):
    from tallyscope import config

    tests = dl.engine_test(v.activity(spark, d), ["account_id"], "amount")
    return dl.configured(tests, ["account_id"], config.digit_dimension(spark)).select("account_id", "mode", "verdict")


@query("b2_benford_ledger", _engine_sql("ledger", "session_id", D1, FIRST, 1), ["ledger"])
def b2_ledger(spark, d):
    return _engine(v.ledger(spark, d, "session_id", "amount"), ["session_id"])


@query(
    "b3_step_p_value",
    f"""WITH {_digit_table_sql(NONZERO, 'account_id', D1, FIRST)}, x AS (SELECT account_id, sum(pow(n - expected * total, 2) / (expected * total)) AS chi FROM t GROUP BY 1)
    SELECT account_id, CASE WHEN chi > 20 THEN 0.001 WHEN chi > 15 THEN 0.05 WHEN chi > 10 THEN 0.1 ELSE 0.5 END::DOUBLE AS p_value FROM x""",
    ["activity"],
)
def b3(spark, d):
    return dl.engine_test(v.activity(spark, d), ["account_id"], "amount").select("account_id", F.col("p_value").cast("double").alias("p_value"))


EVEN_P = "exp(-chi / 2) * (1 + chi / 2 + pow(chi / 2, 2) / 2 + pow(chi / 2, 3) / 6)"


@query(
    "b4_exact_p_value",
    f"""WITH {_digit_table_sql(NONZERO, 'account_id', D1, FIRST)}, x AS (SELECT account_id, sum(pow(n - expected * total, 2) / (expected * total)) AS chi FROM t GROUP BY 1)
    SELECT account_id, round(chi, 4) AS chi_square, round({EVEN_P}, 6) AS p_value FROM x""",
    ["activity"],
)
def b4(spark, d):
    from tallyscope.functions.chi2 import p_value

    out = dl.engine_test(v.activity(spark, d), ["account_id"], "amount")
    return out.select("account_id", r("chi_square", 4).alias("chi_square"), r(p_value(F.col("chi_square"), 8)).alias("p_value"))


def _significant_sql(source, key, grades):
    return f"""
    WITH {_digit_table_sql(source, key, SIG, FIRST)},
    k AS (SELECT *, abs(sum(observed) OVER (PARTITION BY {key} ORDER BY digit) - sum(expected) OVER (PARTITION BY {key} ORDER BY digit)) AS gap FROM t WHERE total >= 10),
    x AS (SELECT {key}, max(total) AS total, sum(pow(n - greatest(expected * total, 0.5), 2) / greatest(expected * total, 0.5)) AS chi, max(gap) AS ks,
                 avg(abs(deviation)) AS mad, sum(abs(deviation)) AS dev, count(*) FILTER (abs(deviation) > 0.02) AS odd FROM k GROUP BY 1),
    p AS (SELECT *, CASE WHEN chi > 1400 THEN 0 ELSE {EVEN_P} END AS p FROM x)
    SELECT {key}, CAST(total AS BIGINT) AS total_values, round(chi, 4) AS chi_square, round(ks, 6) AS ks_statistic, round(mad, 6) AS mean_absolute_deviation,
           round(dev, 6) AS deviation_score, odd AS anomalous_digits, round(p, 6) AS p_value, round(2 * exp(-18 * ks * ks), 6) AS ks_p_value,
           round(least(2 * exp(-2 * total * ks * ks), 1), 6) AS ks_p_value_sample, p < 0.05 AS significant, {grades} AS conformity FROM p
    """


FOUR = "CASE WHEN p > 0.1 THEN 'good' WHEN p > 0.05 THEN 'acceptable' WHEN p > 0.01 THEN 'questionable' ELSE 'poor' END"
THREE = "CASE WHEN p > 0.05 THEN 'good' WHEN p > 0.01 THEN 'questionable' ELSE 'poor' END"


@query("b5_significant_digit", _significant_sql(NONZERO, "account_id", FOUR), ["activity"])
def b5(spark, d):
    return rounded(dl.significant_test(v.activity(spark, d), ["account_id"], "amount"), chi_square=4)


@query("b6_analyzer_digit", _significant_sql("ledger", "account_code", THREE), ["ledger"])
def b6(spark, d):
    return rounded(dl.significant_test(v.ledger(spark, d, "account_code", "amount"), ["account_code"], "amount", levels=3), chi_square=4)


@query(
    "w9_cumulative_gap",
    f"""WITH {_digit_table_sql(NONZERO, 'category', SIG, FIRST)}
    SELECT category, digit, round(sum(observed) OVER (PARTITION BY category ORDER BY digit), 6) AS cum_observed, round(sum(expected) OVER (PARTITION BY category ORDER BY digit), 6) AS cum_expected FROM t""",
    ["activity"],
)
def w9(spark, d):
    from pyspark.sql import Window

    t = dl.significant_table(v.activity(spark, d), ["category"], "amount")
    w = Window.partitionBy("category").orderBy("digit")
    return t.select("category", "digit", r(F.sum("observed").over(w)).alias("cum_observed"), r(F.sum("expected").over(w)).alias("cum_expected"))


@query(
    "t6_anomalous_digits",
    f"""WITH {_digit_table_sql(NONZERO, 'account_id', SIG, FIRST)}
    SELECT account_id, digit, round(observed, 6) AS observed, round(expected, 6) AS expected, round(abs(deviation), 6) AS deviation, round(abs(deviation) / expected * 100, 4) AS deviation_percentage,
           row_number() OVER (PARTITION BY account_id ORDER BY round(abs(deviation), 9) DESC, digit) AS rank FROM t WHERE abs(deviation) > 0.02""",
    ["activity"],
)
def t6(spark, d):
    t = dl.significant_table(v.activity(spark, d), ["account_id"], "amount")
    return rounded(dl.anomalous_digits(t, ["account_id"]), deviation_percentage=4)


PAIR_TEXT = "replace(CAST(CAST(abs(amount) AS DECIMAL(28,10)) AS VARCHAR), '.', '')"
# upper tail with nine degrees of freedom: one minus the lower series of the incomplete gamma function
ODD_P = (
    "CASE WHEN chi > 900 THEN 0 WHEN chi <= 0 THEN 1 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 2500), "
    "lambda i: exp((4.5 + i) * ln(chi / 2) - chi / 2 - lgamma(5.5 + i))))) END"
)


def _second_sql(key):
    return f"""
    pr AS (SELECT {key}, CAST(left({PAIR_TEXT}, 1) AS INTEGER) AS d1, CAST(substr({PAIR_TEXT}, 2, 1) AS INTEGER) AS digit FROM activity
           WHERE amount <> 0 AND left({PAIR_TEXT}, 1) <> '0'),
    pc AS (SELECT {key}, d1, digit, count(*) AS n FROM pr GROUP BY ALL),
    pt AS (SELECT {key}, d1, sum(n) AS total FROM pc GROUP BY ALL HAVING sum(n) >= 5),
    ex AS (SELECT CAST(a.range AS INTEGER) AS d1, CAST(b.range AS INTEGER) AS digit,
                  log10(1 + 1.0::DOUBLE / (a.range * 10 + b.range)) / log10(1 + 1.0::DOUBLE / a.range) AS expected FROM range(1, 10) a, range(0, 10) b),
    pj AS (SELECT pt.{key}, pt.d1, total, expected, coalesce(n, 0) AS n FROM pt JOIN ex ON ex.d1 = pt.d1
           LEFT JOIN pc ON pc.{key} = pt.{key} AND pc.d1 = pt.d1 AND pc.digit = ex.digit),
    px AS (SELECT {key}, d1, max(total) AS total, sum(pow(n - greatest(expected * total, 0.5), 2) / greatest(expected * total, 0.5)) AS chi FROM pj GROUP BY 1, 2),
    pp AS (SELECT *, {ODD_P} AS p FROM px),
    pg AS (SELECT *, {FOUR} AS conformity FROM pp)
    """


@query(
    "b7_second_digit_given_first",
    f"WITH {_second_sql('category')} SELECT category, d1, CAST(total AS BIGINT) AS sample_size, round(chi, 4) AS chi_square, round(p, 6) AS p_value, conformity FROM pg",
    ["activity"],
)
def b7(spark, d):
    return rounded(dl.second_digit_test(v.activity(spark, d), ["category"], "amount"), chi_square=4)


@query(
    "b8_conditional_expected",
    """
    WITH p AS (SELECT CAST(left(CAST(CAST(trunc(amount) AS BIGINT) AS VARCHAR), 1) AS INTEGER) AS d1, CAST(substr(CAST(CAST(trunc(amount) AS BIGINT) AS VARCHAR), 2, 1) AS INTEGER) AS digit, count(*) AS n
               FROM ledger GROUP BY ALL),
         e AS (SELECT a.range AS d1, b.range AS digit, sum(log10(1 + 1.0::DOUBLE / (a.range * 10 + b.range + k.range * 100))) / a.range AS reference_share,
                      log10(1 + 1.0::DOUBLE / (a.range * 10 + b.range)) / log10(1 + 1.0::DOUBLE / a.range) AS exact_share
               FROM range(1, 10) a, range(0, 10) b, range(0, 10) k GROUP BY 1, 2)
    SELECT p.d1, p.digit, n, round(reference_share, 9) AS reference_share, round(exact_share, 9) AS exact_share FROM p JOIN e ON e.d1 = p.d1 AND e.digit = p.digit
    """,
    ["ledger"],
)
def b8(spark, d):
    pairs = v.ledger(spark, d, "amount").select(dg.digit_pair(F.col("amount")).alias("p")).groupBy(F.col("p.d1").alias("d1"), F.col("p.d2").alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    both = dl.conditional_expected(spark, "reference").withColumnRenamed("expected", "reference_share").join(
        dl.conditional_expected(spark, "exact").withColumnRenamed("expected", "exact_share"), ["d1", "digit"]
    )
    return rounded(pairs.join(F.broadcast(both), ["d1", "digit"]), 9)


@query(
    "b9_comprehensive_digits",
    f"""WITH {_digit_table_sql(NONZERO, 'category', SIG, FIRST)}, {_second_sql('category')},
    f AS (SELECT category, sum(abs(deviation)) AS dev FROM t WHERE total >= 10 GROUP BY 1),
    s AS (SELECT category, avg(p) AS mp, avg(CASE conformity WHEN 'good' THEN 3 WHEN 'acceptable' THEN 2 WHEN 'questionable' THEN 1 ELSE 0 END) AS ms FROM pg GROUP BY 1),
    o AS (SELECT category, dev, mp, ms, 0.7 * (1 - dev) + 0.3 * coalesce(mp, 0) AS score FROM f LEFT JOIN s USING (category))
    SELECT category, round(dev, 6) AS deviation_score, round(mp, 6) AS mean_p, round(score, 6) AS overall_compliance_score,
           CASE WHEN ms >= 2.5 THEN 'good' WHEN ms >= 1.5 THEN 'acceptable' WHEN ms >= 0.5 THEN 'questionable' ELSE 'poor' END AS overall_conformity,
           CASE WHEN score >= 0.8 THEN 'high_compliance' WHEN score >= 0.6 THEN 'moderate_compliance' WHEN score >= 0.4 THEN 'low_compliance' ELSE 'poor_compliance' END AS assessment FROM o""",
    ["activity"],
)
def b9(spark, d):
    out = dl.comprehensive(v.activity(spark, d), ["category"], "amount")
    return rounded(out.select("category", "deviation_score", "mean_p", "overall_compliance_score", "overall_conformity", "assessment"))


@query(
    "r11_digit_advice",
    f"""WITH {_digit_table_sql(NONZERO, 'category', SIG, FIRST)}, {_second_sql('category')},
    x AS (SELECT category, sum(pow(n - greatest(expected * total, 0.5), 2) / greatest(expected * total, 0.5)) AS chi FROM t WHERE total >= 10 GROUP BY 1),
    f AS (SELECT category, CASE WHEN chi > 1400 THEN 0 ELSE {EVEN_P} END < 0.05 AS sig FROM x),
    w AS (SELECT category, digit, abs(deviation) / expected * 100 AS pct, row_number() OVER (PARTITION BY category ORDER BY round(abs(deviation), 9) DESC, digit) AS r FROM t WHERE abs(deviation) > 0.02),
    s AS (SELECT category, avg(CASE conformity WHEN 'good' THEN 3 WHEN 'acceptable' THEN 2 WHEN 'questionable' THEN 1 ELSE 0 END) AS ms FROM pg GROUP BY 1),
    o AS (SELECT f.category, concat_ws('|', CASE WHEN sig THEN 'First digit distribution shows significant deviation from Benford''s Law' END,
                 CASE WHEN sig AND digit IS NOT NULL THEN 'Digit ' || digit || ' shows highest deviation (' || format('{{:.1f}}', pct) || '%)' END,
                 CASE WHEN coalesce(ms, 0) < 1.5 THEN 'Second digit distribution suggests potential data manipulation' END) AS a
          FROM f LEFT JOIN w ON w.category = f.category AND r = 1 LEFT JOIN s ON s.category = f.category)
    SELECT category, CASE WHEN a = '' THEN 'Data appears to conform well to Benford''s Law' ELSE a || '|Consider investigating transactions contributing to digit anomalies|Review data collection and entry processes for potential issues' END AS advice FROM o""",
    ["activity"],
)
def r11_digits(spark, d):
    out = dl.digit_advice(v.activity(spark, d), ["category"], "amount")
    return out.select("category", F.array_join("recommendations", "|").alias("advice"))


@query(
    "b10_newcomb",
    f"""WITH {_digit_table_sql(NONZERO, 'account_id', D1, FIRST)},
    x AS (SELECT account_id, sum(pow(n - expected * total, 2) / (expected * total)) AS chi, max(observed) FILTER (digit = 1) AS s1, max(observed) FILTER (digit = 2) AS s2,
                 max(observed) FILTER (digit = 3) AS s3, max(observed) FILTER (digit = 5) AS s5 FROM t GROUP BY 1),
    y AS (SELECT *, s1 > 0.35 OR s5 > 0.12 AS rb, s2 > 0.20 OR s3 > 0.15 AS np, least(chi / 31.014, 1) AS base FROM x),
    z AS (SELECT *, CASE WHEN rb THEN least(base + 0.1, 1) ELSE base END AS s FROM y)
    SELECT account_id, rb AS round_number_bias, np AS number_preference, round(CASE WHEN np THEN least(s + 0.05, 1) ELSE s END, 6) AS risk_score FROM z""",
    ["activity"],
)
def b10(spark, d):
    out = dl.newcomb(dl.engine_test(v.activity(spark, d), ["account_id"], "amount"))
    return out.select("account_id", "round_number_bias", "number_preference", r("risk_score").alias("risk_score"))


@query(
    "b11_manipulation_patterns",
    f"""WITH {_digit_table_sql('ledger', 'account_code', D1, FIRST)}
    SELECT account_code, max(observed) FILTER (digit = 1) > 0.35 AS excess_1, max(observed) FILTER (digit = 5) > 0.12 AS excess_5, max(observed) FILTER (digit = 2) > 0.20 AS excess_2,
           max(observed) FILTER (digit = 3) > 0.15 AS excess_3,
           coalesce(string_agg(CASE WHEN observed < 0.02 AND digit IN (7, 8, 9) THEN CAST(digit AS VARCHAR) END, ',' ORDER BY digit), '') AS avoided_digits,
           stddev_pop(observed) / avg(observed) < 0.3 AS too_uniform FROM t GROUP BY account_code""",
    ["ledger"],
)
def b11(spark, d):
    counts = dl.digit_counts(v.ledger(spark, d, "account_code", "amount"), ["account_code"], dg.integer_digit(F.col("amount")))
    return dl.manipulation_patterns(dl.digit_table(counts, ["account_code"], dl.expected_digits(spark, 1)), ["account_code"])


@query(
    "b12_two_digit_test",
    f"""WITH {_digit_table_sql('(SELECT * FROM activity WHERE abs(amount) >= 10)', 'category', LEAD2, PAIRS)}
    SELECT category, CAST(max(total) AS BIGINT) AS sample_size, round(sum(pow(n - expected * total, 2) / (expected * total)), 4) AS chi_square,
           round(avg(abs(deviation)), 6) AS mean_absolute_deviation, count(*) FILTER (n = 0) AS empty_classes FROM t GROUP BY category""",
    ["activity"],
)
def b12(spark, d):
    return rounded(dl.two_digit_test(v.activity(spark, d), ["category"], "amount"), chi_square=4)


TOKENS = (
    "SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), "
    "lambda w: regexp_full_match(w, '[a-z]{3,}'))) AS word FROM documents"
)
STOP = (
    "('the','and','or','but','in','on','at','to','for','of','with','by','is','are','was','were','be','been','have','has','had','do','does','did',"
    "'will','would','could','should','may','might','can','shall','must','a','an')"
)


@query(
    "f6_tokens",
    f"WITH w AS ({TOKENS}) SELECT doc_id, count(*) AS n, count(DISTINCT word) AS distinct_words, count(*) FILTER (word NOT IN {STOP}) AS without_stopwords FROM w GROUP BY doc_id",
)
def f6(spark, d):
    t = v.table(spark, d, "documents").select("doc_id", words(F.col("text")).alias("w"), words(F.col("text"), 3, True).alias("k"))
    out = t.select("doc_id", F.size("w").cast("bigint").alias("n"), F.size(F.array_distinct("w")).cast("bigint").alias("distinct_words"), F.size("k").cast("bigint").alias("without_stopwords"))
    return out.where(F.col("n") > 0)


RANK_SQL = f"""
    w AS ({TOKENS}), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank, count(*) OVER (PARTITION BY lang) AS items,
                  n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE) AS frequency FROM c),
    ex AS (SELECT *, (1.0::DOUBLE / rank) / sum(1.0::DOUBLE / rank) OVER (PARTITION BY lang) AS expected FROM rk)
"""


def _ranks(spark, d):
    counts = wl.word_counts(v.table(spark, d, "documents"), ["lang"], "text")
    return wl.ranked(counts, ["lang"], "word", "count")


@query("w10_word_ranks", f"WITH {RANK_SQL} SELECT lang, word, n AS \"count\", rank, round(frequency, 9) AS frequency FROM rk")
def w10(spark, d):
    return _ranks(spark, d).select("lang", "word", "count", "rank", r("frequency", 9).alias("frequency"))


@query("t5_top_words", f"WITH {RANK_SQL} SELECT lang, word, rank FROM rk WHERE rank <= 100")
def t5(spark, d):
    return _ranks(spark, d).where(F.col("rank") <= 100).select("lang", "word", "rank")


@query("z2_expected_frequency", f"WITH {RANK_SQL} SELECT lang, rank, round(expected, 9) AS expected FROM ex")
def z2(spark, d):
    return wl.with_expected(_ranks(spark, d), ["lang"]).select("lang", "rank", r("expected", 9).alias("expected"))


@query(
    "z1_zipf_words",
    f"""WITH {RANK_SQL},
    x AS (SELECT lang, sum(n) AS total, max(items) AS items, corr(CASE WHEN rank <= 100 THEN ln(frequency) END, CASE WHEN rank <= 100 THEN ln(1.0::DOUBLE / rank) END) AS cr,
                 max(abs(frequency - expected)) AS ks, count(*) FILTER (rank <= 50 AND abs(frequency - expected) / expected > 0.5) AS odd FROM ex GROUP BY 1),
    y AS (SELECT *, CASE WHEN items >= 100 THEN cr ELSE 0 END AS cc FROM x)
    SELECT lang, CAST(total AS BIGINT) AS sample_size, items, round(ks, 6) AS ks_statistic, odd AS anomalous_items, round(cc, 6) AS correlation,
           round(CASE WHEN ks > 0 THEN 2 * exp(-2 * items * ks * ks) ELSE 1 END, 6) AS p_value, round(greatest(0, 1 - abs(cc)), 6) AS risk_score FROM y""",
)
def z1(spark, d):
    return rounded(wl.zipf_test(wl.with_expected(_ranks(spark, d), ["lang"]), ["lang"]))


@query(
    "z3_zipf_correlation",
    f"""WITH {RANK_SQL}, x AS (SELECT lang, count(*) FILTER (rank <= 100) AS items_used, corr(CASE WHEN rank <= 100 THEN ln(n) END, CASE WHEN rank <= 100 THEN ln(1.0::DOUBLE / rank) END) AS cr FROM rk GROUP BY 1)
    SELECT lang, items_used, round(CASE WHEN items_used < 10 THEN 0 ELSE coalesce(cr, 0) END, 6) AS correlation FROM x""",
)
def z3(spark, d):
    return rounded(wl.zipf_correlation(_ranks(spark, d), ["lang"]))


@query(
    "z4_vendor_zipf",
    """
    WITH c AS (SELECT session_id, vendor_name, CAST(sum(amount) AS DOUBLE) AS paid FROM ledger WHERE vendor_name <> '' GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY paid DESC, vendor_name) AS rank, count(*) OVER (PARTITION BY session_id) AS items,
                  paid / sum(paid) OVER (PARTITION BY session_id) AS frequency FROM c),
    ex AS (SELECT *, (1.0::DOUBLE / rank) / sum(1.0::DOUBLE / rank) OVER (PARTITION BY session_id) AS expected FROM rk),
    x AS (SELECT session_id, sum(paid) AS total, max(items) AS items, corr(CASE WHEN rank <= 100 THEN ln(frequency) END, CASE WHEN rank <= 100 THEN ln(1.0::DOUBLE / rank) END) AS cr,
                 max(abs(frequency - expected)) AS ks, count(*) FILTER (rank <= 50 AND abs(frequency - expected) / expected > 0.5) AS odd,
                 max(frequency) AS top_share, corr(ln(frequency), ln(1.0::DOUBLE / rank)) AS ac FROM ex GROUP BY 1),
    y AS (SELECT *, CASE WHEN items >= 100 THEN cr ELSE 0 END AS cc FROM x WHERE items >= 20)
    SELECT session_id, round(total, 2) AS sample_size, items, round(ks, 6) AS ks_statistic, odd AS anomalous_items, round(cc, 6) AS correlation,
           round(CASE WHEN ks > 0 THEN 2 * exp(-2 * items * ks * ks) ELSE 1 END, 6) AS p_value, round(greatest(0, 1 - abs(cc)), 6) AS risk_score,
           round(top_share, 6) AS top_share, round(ac, 6) AS all_correlation FROM y
    """,
    ["ledger"],
)
def z4(spark, d):
    return rounded(wl.vendor_zipf(v.ledger(spark, d, "session_id", "vendor_name", "amount"), ["session_id"]), sample_size=2)
