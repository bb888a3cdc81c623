"""Statistics: descriptions, quality, correlation, intervals, trends, returns, scaling, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions import scores as sc
from tallyscope.operators import evaluation, features, outliers, sessions, stats
from tallyscope.operators.ordered import trailing_count
from tallyscope.operators.quantiles import exact_percentiles, join_stats, with_median_gap
from tallyscope.plans import views as v
from tallyscope.plans.catalog.ledgers import r
from tallyscope.plans.registry import query


def rounded(df, n=6, **special):
    """Round every double column; ``special`` gives other digits by column."""
    return df.select(*[r(c, special.get(c, n)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "a5_descriptive",
    """
    WITH m AS (SELECT category, count(*) AS "count", avg(amount) AS mean, median(amount) AS median, stddev_pop(amount) AS std_dev,
                      var_pop(amount) AS variance, min(amount) AS min_value, max(amount) AS max_value,
                      quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3, kurtosis_pop(amount) AS kurtosis FROM activity GROUP BY 1),
         s AS (SELECT a.category, sum(pow(a.amount - m.mean, 3)) / count(*) / pow(any_value(m.std_dev), 3) AS skewness
               FROM activity a JOIN m USING (category) GROUP BY 1)
    SELECT category, "count", round(mean, 6) AS mean, round(median, 6) AS median, round(std_dev, 6) AS std_dev, round(variance, 4) AS variance,
           min_value, max_value, round(max_value - min_value, 6) AS "range", round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis,
           round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(std_dev / mean, 6) AS coefficient_variation
    FROM m JOIN s USING (category)
    """,
    ["activity"],
)
def a5(spark, d):
    return rounded(stats.describe(v.activity(spark, d), ["category"], "amount"), variance=4)


@query(
    "a6_column_quality",
    """
    WITH t AS (SELECT id, account_id, category, amount, k FROM activity),
         l AS (SELECT 'id' AS "column", CAST(id AS DOUBLE) AS x FROM t UNION ALL SELECT 'account_id', account_id FROM t
               UNION ALL SELECT 'amount', amount FROM t UNION ALL SELECT 'k', k FROM t),
         q AS (SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, var_samp(x) AS variance FROM l GROUP BY 1),
         o AS (SELECT "column", count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers FROM l JOIN q USING ("column") GROUP BY 1)
    SELECT (SELECT count(*) FROM t) AS "rows", q."column", CAST(0 AS BIGINT) AS missing, round(variance, 3) AS variance, outliers FROM q JOIN o USING ("column")
    UNION ALL SELECT (SELECT count(*) FROM t), 'category', CAST(0 AS BIGINT), NULL, NULL
    """,
    ["activity"],
)
def a6(spark, d):
    rows = v.activity(spark, d).select("id", "account_id", "category", "amount", "k")
    return stats.column_quality(rows).select("rows", "column", "missing", r("variance", 3).alias("variance"), "outliers")


@query(
    "a6_quality_score",
    """
    WITH t AS (SELECT l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, CASE WHEN l_partkey % 11 <> 0 THEN 'C' END AS contract_id FROM lineitem),
         c AS (SELECT count(*) AS n, count(*) FILTER (contract_id IS NULL) AS miss FROM t),
         l AS (SELECT 1 AS c, CAST(l_partkey AS DOUBLE) AS x FROM t UNION ALL SELECT 2, l_suppkey FROM t UNION ALL SELECT 3, l_quantity FROM t
               UNION ALL SELECT 4, l_discount FROM t),
         q AS (SELECT c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY 1),
         o AS (SELECT c, round(count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) / CAST(count(*) AS DOUBLE) * 100, 2) AS pct FROM l JOIN q USING (c) GROUP BY 1),
         d AS (SELECT CAST(sum(k - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS k FROM t GROUP BY l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, contract_id)),
         p AS (SELECT n AS total_rows, CAST(6 AS BIGINT) AS total_columns, round(miss / CAST(n AS DOUBLE) * 100, 2) / 6 AS avg_missing_pct, CAST(0 AS BIGINT) AS zero_variance_columns,
                      (SELECT avg(pct) FROM o) AS avg_outlier_pct, duplicates FROM c, d)
    SELECT total_rows, total_columns, round(avg_missing_pct, 6) AS avg_missing_pct, zero_variance_columns, round(avg_outlier_pct, 6) AS avg_outlier_pct, duplicates,
           round(greatest(0, least(1, 1 - avg_missing_pct / 100 * 0.3 - duplicates / CAST(total_rows AS DOUBLE) * 0.2
                 - CASE WHEN avg_outlier_pct > 10 THEN (avg_outlier_pct - 10) / 100 * 0.3 ELSE 0 END)), 6) AS overall_quality_score
    FROM p
    """,
)
def a6_score(spark, d):
    rows = v.table(spark, d, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag",
        F.when(F.col("l_partkey") % 11 != 0, F.lit("C")).alias("contract_id"),
    )
    return rounded(stats.quality_score(rows))


@query(
    "a7_sample_size",
    """
    SELECT account_id, count(*) AS n, count(*) >= 30 AS adequate,
           CASE WHEN count(*) < 30 THEN 'Sample size ' || count(*) || ' below minimum required 30'
                WHEN count(*) < 100 THEN 'Sample size adequate but limited statistical power'
                WHEN count(*) < 1000 THEN 'Good sample size for statistical analysis'
                ELSE 'Excellent sample size for robust statistical analysis' END AS message
    FROM activity GROUP BY account_id
    """,
    ["activity"],
)
def a7(spark, d):
    counts = v.activity(spark, d).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    adequate, message = stats.sample_size_verdict(F.col("n"))
    return counts.withColumn("adequate", adequate).withColumn("message", message)


@query(
    "a8_amount_text_quality",
    """
    WITH f AS (SELECT transaction_type, count(*) AS sample_size, CAST(min(amount) AS DOUBLE) AS min_amount, CAST(max(amount) AS DOUBLE) AS max_amount,
                      round(avg(CAST(amount AS DOUBLE)), 4) AS mean_amount, count(*) FILTER (amount = 0) AS zero_amounts, count(*) FILTER (amount < 0) AS negative_amounts
               FROM ledger GROUP BY 1),
         t AS (SELECT transaction_type, count(*) AS text_entries,
                      CAST(sum(len(list_filter(regexp_split_to_array(trim(description), '[ \\t\\n]+'), lambda w: w <> ''))) AS BIGINT) AS total_words,
                      count(*) FILTER (trim(description) = '') AS empty_entries FROM ledger GROUP BY 1)
    SELECT *, sample_size >= 30 AS sample_size_adequate,
           CASE WHEN sample_size < 30 THEN 'Sample size ' || sample_size || ' below minimum required 30' WHEN sample_size < 100 THEN 'Sample size adequate but limited statistical power'
                WHEN sample_size < 1000 THEN 'Good sample size for statistical analysis' ELSE 'Excellent sample size for robust statistical analysis' END AS sample_size_message,
           round((CASE WHEN sample_size >= 30 THEN 1.0 ELSE 0.5 END * CASE WHEN zero_amounts > 0 THEN 0.9 ELSE 1.0 END + least(total_words / 100.0::DOUBLE, 1)) / 2.0::DOUBLE, 6) AS overall_quality_score
    FROM f JOIN t USING (transaction_type)
    """,
    ["ledger"],
)
def a8(spark, d):
    rows = v.ledger(spark, d, "transaction_type", "amount", "description")
    return rounded(stats.amount_text_quality(rows, rows, ["transaction_type"], "amount", "description"), mean_amount=4)


@query(
    "a9_correlated_pairs",
    """
    WITH t AS (SELECT l_quantity AS a, l_extendedprice AS b, l_extendedprice * 1.1 + l_quantity AS c, l_discount AS d FROM lineitem)
    SELECT * FROM (SELECT 'a' AS column_a, 'b' AS column_b, round(abs(corr(a, b)), 6) AS correlation FROM t UNION ALL SELECT 'a', 'c', round(abs(corr(a, c)), 6) FROM t
     UNION ALL SELECT 'a', 'd', round(abs(corr(a, d)), 6) FROM t UNION ALL SELECT 'b', 'c', round(abs(corr(b, c)), 6) FROM t
     UNION ALL SELECT 'b', 'd', round(abs(corr(b, d)), 6) FROM t UNION ALL SELECT 'c', 'd', round(abs(corr(c, d)), 6) FROM t) WHERE correlation > 0.9
    """,
)
def a9(spark, d):
    rows = v.table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"),
        (F.col("l_extendedprice") * 1.1 + F.col("l_quantity")).alias("c"), F.col("l_discount").alias("d"),
    )
    return rounded(stats.correlated_pairs(rows))


@query(
    "a13_document_runs",
    """
    SELECT language, count(*) AS documents, round(avg(CASE WHEN processing_status = 'completed' THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
           round(avg(CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') THEN 1.0 ELSE 0.0 END), 6) AS pii_rate,
           round(avg(CASE WHEN confidence_score IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unscored_rate
    FROM docs GROUP BY language
    """,
    ["docs"],
)
def a13(spark, d):
    def share(flag):
        return F.avg(flag.cast("int"))

    return rounded(v.documents(spark, d).groupBy("language").agg(
        F.count(F.lit(1)).alias("documents"),
        share(F.col("processing_status") == "completed").alias("success_rate"),
        share(F.col("text").rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}")).alias("pii_rate"),
        share(F.col("confidence_score").isNull()).alias("unscored_rate"),
    ))


@query(
    "a20_percentile_interval",
    "SELECT category, count(*) AS n, round(quantile_cont(amount, 0.025), 6) AS lower, round(quantile_cont(amount, 0.975), 6) AS upper FROM activity GROUP BY category",
    ["activity"],
)
def a20(spark, d):
    return rounded(stats.percentile_interval(v.activity(spark, d), ["category"], "amount"))


RETURNS_SQL = """
    p AS (SELECT account_id, ts, id, amount, lag(amount) OVER (PARTITION BY account_id ORDER BY ts, id) AS before FROM activity),
    rr AS (SELECT *, (amount - before) / nullif(before, 0) AS r FROM p)
"""


def _returns(spark, d):
    rows = v.activity(spark, d).select("id", "account_id", "ts", "amount")
    return stats.returns(rows, ["account_id"], [F.col("ts"), F.col("id")], "amount")


@query("w5_simple_returns", f"WITH {RETURNS_SQL} SELECT id, account_id, round(r, 6) AS r FROM rr", ["activity"])
def w5(spark, d):
    return _returns(spark, d).select("id", "account_id", r("r").alias("r"))


@query(
    "a21_value_at_risk",
    f"WITH {RETURNS_SQL} SELECT account_id, count(r) AS n, round(quantile_cont(r, 0.05), 6) AS value_at_risk FROM rr WHERE r IS NOT NULL GROUP BY account_id",
    ["activity"],
)
def a21(spark, d):
    return rounded(stats.value_at_risk(_returns(spark, d), ["account_id"], "r"))


@query(
    "w6_return_risk",
    f"""WITH {RETURNS_SQL} SELECT account_id, round(stddev_pop(r), 4) AS volatility, round(coalesce(stddev_pop(r) FILTER (r < 0), 0), 6) AS downside_deviation,
        round(quantile_cont(r, 0.05), 6) AS value_at_risk_95, round(quantile_cont(r, 0.01), 6) AS value_at_risk_99,
        round(coalesce(avg(r) / nullif(stddev_pop(r), 0), 0), 6) AS sharpe_ratio, round(stddev_pop(amount) / nullif(avg(amount), 0), 6) AS coefficient_of_variation
        FROM rr GROUP BY account_id""",
    ["activity"],
)
def w6(spark, d):
    return rounded(stats.return_risk(_returns(spark, d), ["account_id"], "amount"), volatility=4)


@query(
    "w7_max_drawdown",
    """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts, id) AS i FROM activity),
         c AS (SELECT *, max(amount) OVER (PARTITION BY account_id ORDER BY ts, id) AS peak FROM n WHERE i > 1)
    SELECT account_id, round(min((amount - peak) / peak), 6) AS max_drawdown FROM c GROUP BY account_id
    """,
    ["activity"],
)
def w7(spark, d):
    rows = v.activity(spark, d).select("id", "account_id", "ts", "amount")
    return rounded(stats.max_drawdown(rows, ["account_id"], [F.col("ts"), F.col("id")], "amount"))


@query(
    "a22_trend",
    """
    WITH p AS (SELECT account_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS pos, avg(k / 100.0::DOUBLE) AS score FROM activity GROUP BY 1, 2),
         t AS (SELECT account_id, count(*) AS n, regr_slope(score, pos) AS s, stddev_pop(score) AS v, arg_max(score, pos) AS latest, max(score) - min(score) AS rg FROM p GROUP BY 1)
    SELECT account_id, n, round(s, 6) AS trend_slope, round(v, 6) AS volatility, round(latest, 6) AS latest_score, round(rg, 6) AS score_range,
           CASE WHEN n < 2 THEN 'insufficient_data' WHEN abs(s) < 0.01 THEN 'stable' WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
           round(CASE WHEN n < 2 THEN 0 ELSE least(greatest(s * 2, 0), 0.3) END, 6) AS trend_risk
    FROM t
    """,
    ["activity"],
)
def a22(spark, d):
    daily = v.activity(spark, d).groupBy("account_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("pos")).agg(
        F.avg(F.col("k") / F.lit(100.0)).alias("score")
    )
    return rounded(stats.trend(daily, ["account_id"], "pos", "score"))


@query(
    "a30_health",
    """
    SELECT category, count(DISTINCT account_id) AS active_sessions, count(*) AS total_documents_processed, round(avg(amount), 6) AS average_processing_time,
           round(count(*) FILTER (k < 10) / CAST(count(*) AS DOUBLE), 6) AS error_rate FROM activity GROUP BY category
    """,
    ["activity"],
)
def a30(spark, d):
    return rounded(sessions.health(v.activity(spark, d), ["category"], "account_id", "amount", F.col("k") < 10))


@query(
    "a28_operational_metrics",
    """
    SELECT category, CASE WHEN k < 20 THEN 'high' ELSE 'low' END AS severity, count(*) AS n,
           count(*) FILTER (amount < 1) AS b0, count(*) FILTER (amount >= 1 AND amount < 10) AS b1,
           count(*) FILTER (amount >= 10 AND amount < 100) AS b2, count(*) FILTER (amount >= 100) AS b3
    FROM activity GROUP BY ALL
    """,
    ["activity"],
)
def a28(spark, d):
    x = F.col("amount")
    return v.activity(spark, d).groupBy("category", F.when(F.col("k") < 20, "high").otherwise("low").alias("severity")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(x < 1).alias("b0"),
        F.count_if((x >= 1) & (x < 10)).alias("b1"),
        F.count_if((x >= 10) & (x < 100)).alias("b2"),
        F.count_if(x >= 100).alias("b3"),
    )


@query(
    "a28_duration_percentiles",
    "SELECT category, count(*) AS n, round(quantile_cont(amount, 0.5), 6) AS p50, round(quantile_cont(amount, 0.95), 6) AS p95, round(quantile_cont(amount, 0.99), 6) AS p99 FROM activity GROUP BY category",
    ["activity"],
)
def a28_durations(spark, d):
    return rounded(exact_percentiles(v.activity(spark, d), ["category"], "amount", {"p50": 0.5, "p95": 0.95, "p99": 0.99}))


@query(
    "w3_sample_z",
    """
    WITH s AS (SELECT session_id, avg(CAST(amount AS DOUBLE)) AS m, stddev_samp(CAST(amount AS DOUBLE)) AS s FROM ledger GROUP BY 1)
    SELECT txn_id, round(CASE WHEN s > 0 THEN (CAST(amount AS DOUBLE) - m) / s ELSE 0 END, 6) AS z FROM ledger JOIN s USING (session_id)
    """,
    ["ledger"],
)
def w3(spark, d):
    out = stats.z_scores(v.ledger(spark, d, "session_id", "txn_id", "amount"), ["session_id"], "amount")
    return out.select("txn_id", r("z").alias("z"))


@query(
    "w4_population_z",
    """
    WITH s AS (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM activity)
    SELECT id, round((amount - m) / s, 6) AS z, round(ln(greatest(amount, 0.01)), 6) AS log_amount FROM activity, s
    """,
    ["activity"],
)
def w4(spark, d):
    out = stats.z_scores(v.activity(spark, d), [], "amount", sample=False)
    return out.select("id", r("z").alias("z"), r(F.ln(F.greatest("amount", F.lit(0.01)))).alias("log_amount"))


@query(
    "w8_gap_seconds",
    """
    SELECT id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY account_id ORDER BY ts, id)) / 1e6, 6) AS account_gap,
           round((epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, id)) / 1e6, 6) AS gap FROM activity
    """,
    ["activity"],
)
def w8(spark, d):
    rows = v.activity(spark, d).select("id", "account_id", "ts")
    order = [F.col("ts"), F.col("id")]
    rows = features.gap_seconds(rows, ["account_id"], "ts", order, "account_gap")
    rows = features.gap_seconds(rows, [], "ts", order, "gap")
    return rows.select("id", r("account_gap").alias("account_gap"), r("gap").alias("gap"))


@query(
    "w12_trailing_attempts",
    """
    SELECT id, account_id, count(*) OVER (PARTITION BY category ORDER BY epoch_us(ts) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) AS recent,
           count(*) OVER (PARTITION BY category ORDER BY epoch_us(ts) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) >= 4 AS limited
    FROM activity
    """,
    ["activity"],
)
def w12(spark, d):
    rows = v.activity(spark, d).select("id", "account_id", "category", F.unix_micros("ts").alias("us"))
    out = trailing_count(rows, ["category"], "us", 1800)
    return out.select("id", "account_id", "recent", (F.col("recent") >= 4).alias("limited"))


BAND_SQL = """
    WITH c AS (SELECT category, quantile_cont(amount, 0.25) AS c25, quantile_cont(amount, 0.5) AS c50, quantile_cont(amount, 0.75) AS c75,
                      quantile_cont(amount, 0.9) AS c90, quantile_cont(amount, 0.95) AS c95, max(amount) AS c100, avg(amount) AS m FROM activity GROUP BY 1)
    SELECT id, round(abs(amount - m) / m, 6) AS deviation,
           CASE WHEN amount <= c25 THEN 0 WHEN amount <= c50 THEN 1 WHEN amount <= c75 THEN 2 WHEN amount <= c90 THEN 3 WHEN amount <= c95 THEN 4 WHEN amount <= c100 THEN 5 ELSE 6 END AS band
    FROM activity JOIN c USING (category)
"""


@query("w13_deviation_band", BAND_SQL, ["activity"])
def w13(spark, d):
    out = stats.deviation_band(v.activity(spark, d).select("id", "category", "amount"), ["category"], "amount")
    return out.select("id", r("deviation").alias("deviation"), "band")


@query(
    "o1_iqr_outliers",
    """
    WITH q AS (SELECT category, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM activity GROUP BY 1),
         b AS (SELECT category, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM q)
    SELECT category, count(*) FILTER (amount < lower_bound OR amount > upper_bound) AS outlier_count,
           round(count(*) FILTER (amount < lower_bound OR amount > upper_bound) * 100.0::DOUBLE / count(*), 6) AS outlier_percentage,
           round(any_value(lower_bound), 6) AS lower_bound, round(any_value(upper_bound), 6) AS upper_bound
    FROM activity JOIN b USING (category) GROUP BY category
    """,
    ["activity"],
)
def o1(spark, d):
    flagged = outliers.iqr_flags(v.activity(spark, d), ["category"], "amount")
    out = outliers.outlier_summary(flagged, ["category"], "lower_bound", "upper_bound")
    return rounded(out.withColumn("outlier_percentage", F.col("outlier_percentage").cast("double")))


@query(
    "o2_zscore_outliers",
    """
    WITH s AS (SELECT category, avg(amount) AS m, stddev_pop(amount) AS s FROM activity GROUP BY 1)
    SELECT id, category, amount, round((amount - m) / s, 6) AS z FROM activity JOIN s USING (category) WHERE abs((amount - m) / s) > 3
    """,
    ["activity"],
)
def o2(spark, d):
    out = outliers.zscore_flags(v.activity(spark, d), ["category"], "amount").where("is_outlier")
    return out.select("id", "category", "amount", r("z").alias("z"))


MODIFIED_SQL = """
    m AS (SELECT category, median(amount) AS med FROM activity GROUP BY 1),
    g AS (SELECT category, median(abs(amount - med)) AS mad FROM activity JOIN m USING (category) GROUP BY 1),
    z AS (SELECT id, category, amount, CASE WHEN mad <> 0 THEN 0.6745 * (amount - med) / mad ELSE 0 END AS mz FROM activity JOIN m USING (category) JOIN g USING (category))
"""


@query(
    "o3_modified_zscore_outliers",
    f"WITH {MODIFIED_SQL} SELECT id, category, amount, round(mz, 6) AS modified_z FROM z WHERE abs(mz) > 3.5",
    ["activity"],
)
def o3(spark, d):
    out = outliers.modified_zscore_flags(v.activity(spark, d), ["category"], "amount").where("is_outlier")
    return out.select("id", "category", "amount", r("modified_z").alias("modified_z"))


@query(
    "o3_median_gap",
    f"WITH {MODIFIED_SQL} SELECT category, round(med, 6) AS median, round(mad, 6) AS mad FROM m JOIN g USING (category)",
    ["activity"],
)
def o3_gap(spark, d):
    return rounded(with_median_gap(v.activity(spark, d), ["category"], "amount"))


@query(
    "t4_first_outliers",
    f"WITH {MODIFIED_SQL} SELECT * FROM (SELECT id, category, amount, row_number() OVER (PARTITION BY category ORDER BY id) AS rank FROM z WHERE abs(mz) > 3.5) WHERE rank <= 10",
    ["activity"],
)
def t4(spark, d):
    flagged = outliers.modified_zscore_flags(v.activity(spark, d), ["category"], "amount")
    return outliers.first_outliers(flagged, ["category"], [F.col("id")]).select("id", "category", "amount", "rank")


@query(
    "o4_distribution_shape",
    """
    WITH m AS (SELECT session_id, avg(CAST(amount AS DOUBLE)) AS mean, stddev_pop(CAST(amount AS DOUBLE)) AS sd, kurtosis_pop(CAST(amount AS DOUBLE)) AS k FROM ledger GROUP BY 1),
         s AS (SELECT session_id, sum(pow(CAST(amount AS DOUBLE) - mean, 3)) / count(*) / pow(any_value(sd), 3) AS s FROM ledger JOIN m USING (session_id) GROUP BY 1)
    SELECT session_id, round(s, 6) AS skewness, round(k, 6) AS kurtosis, abs(s) < 0.5 AS is_symmetric,
           CASE WHEN abs(s) < 0.5 THEN 'approximately symmetric' WHEN s > 0.5 THEN 'positively skewed (right tail)' ELSE 'negatively skewed (left tail)' END AS skewness_label,
           CASE WHEN abs(k) < 0.5 THEN 'mesokurtic (normal)' WHEN k > 0.5 THEN 'leptokurtic (heavy tails)' ELSE 'platykurtic (light tails)' END AS kurtosis_label,
           k > 3 AS has_heavy_tails FROM m JOIN s USING (session_id)
    """,
    ["ledger"],
)
def o4(spark, d):
    x = F.col("amount").cast("double")
    base = v.ledger(spark, d, "session_id", "amount").groupBy("session_id").agg(F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    return rounded(stats.shape_labels(base))


@query(
    "o5_jarque_bera",
    """
    WITH m AS (SELECT category, count(*) AS n, avg(amount) AS mean, stddev_pop(amount) AS sd, kurtosis_pop(amount) AS k FROM activity GROUP BY 1),
         s AS (SELECT category, sum(pow(amount - mean, 3)) / count(*) / pow(any_value(sd), 3) AS s FROM activity JOIN m USING (category) GROUP BY 1)
    SELECT category, n, round(s, 6) AS skewness, round(k, 6) AS kurtosis, round(n / 6.0 * (s * s + k * k / 4), 3) AS jarque_bera,
           round(exp(-(n / 6.0 * (s * s + k * k / 4)) / 2), 6) AS p_value FROM m JOIN s USING (category)
    """,
    ["activity"],
)
def o5(spark, d):
    return rounded(stats.jarque_bera(v.activity(spark, d), ["category"], "amount"), jarque_bera=3)


@query(
    "o5_ks_normal",
    """
    WITH b AS (SELECT CAST(amount AS DOUBLE) AS x FROM ledger), m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd, count(*) AS n FROM b),
    c AS (SELECT x, count(*) AS c FROM b GROUP BY x), o AS (SELECT x, c, sum(c) OVER (ORDER BY x) AS upto FROM c), z AS (SELECT *, (x - mu) / sd AS z, least(abs((x - mu) / sd), 8) AS a FROM o, m),
    l AS (SELECT range AS k, sum(ln(2 * range + 1)) OVER (ORDER BY range) AS lf FROM range(0, 151)),
    h AS (SELECT x, sum(exp((2 * k + 1) * ln(a) - lf)) * any_value(exp(-a * a / 2)) / sqrt(2 * pi()) AS half FROM z, l WHERE a > 0 GROUP BY x),
    f AS (SELECT z.*, 0.5::DOUBLE + sign(z) * coalesce(half, 0) AS cdf FROM z LEFT JOIN h USING (x)),
    s AS (SELECT max(n) AS n, max(greatest(upto / CAST(n AS DOUBLE) - cdf, cdf - (upto - c) / CAST(n AS DOUBLE))) AS ks FROM f),
    p AS (SELECT n, ks, CASE WHEN sqrt(n) * ks < 0.2 THEN 1 ELSE least(greatest(2 * (SELECT sum(CASE WHEN range % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * range * range * n * ks * ks)) FROM range(1, 101)), 0), 1) END::DOUBLE AS p_value FROM s)
    SELECT CAST(n AS BIGINT) AS n, round(ks, 6) AS ks_statistic, round(p_value, 6) AS p_value, p_value > 0.05 AS is_normal FROM p
    """,
    ["ledger"],
)
def o5_ks(spark, d):
    return rounded(stats.ks_normal(v.ledger(spark, d, "amount"), "amount"))


@query(
    "o6_rule_anomalies",
    """
    WITH s AS (SELECT avg(amount) AS m, stddev_samp(amount) AS s, count(*) FILTER (amount % 100 = 0) / CAST(count(*) AS DOUBLE) AS share FROM activity)
    SELECT id, 'amount_outlier' AS type, round(abs((amount - m) / s), 6) AS measure FROM activity, s WHERE abs((amount - m) / s) > 3
    UNION ALL SELECT id, 'after_hours_transaction', CAST(hour(ts) AS DOUBLE) FROM activity WHERE NOT (hour(ts) BETWEEN 9 AND 17)
    UNION ALL SELECT id, 'round_number', amount FROM activity, s WHERE share > 0.1 AND amount % 100 = 0
    """,
    ["activity"],
)
def o6(spark, d):
    return rounded(outliers.rule_anomalies(v.activity(spark, d), "id", "amount", "ts"))


@query(
    "o7_amount_sanity",
    """
    WITH t AS (SELECT id, 'as_is' AS unit, amount AS x FROM activity UNION ALL SELECT id, 'hundred_thousandths', round(amount * 1e5) FROM activity),
         f AS (SELECT id, unit, concat_ws(',', CASE WHEN x = 0.01 THEN 'penny_amount' END, CASE WHEN x > 100 AND x % 1000 = 0 THEN 'round_number' END, CASE WHEN x > 10000000 THEN 'extremely_large' END) AS flags,
                      (CASE WHEN x = 0.01 THEN 1 ELSE 0 END + CASE WHEN x > 100 AND x % 1000 = 0 THEN 1 ELSE 0 END + CASE WHEN x > 10000000 THEN 1 ELSE 0 END) AS n FROM t)
    SELECT id, unit, flags, round(least(n * 0.3::DOUBLE, 1), 6) AS risk_score, n * 0.3::DOUBLE < 0.5 AS is_safe FROM f
    """,
    ["activity"],
)
def o7(spark, d):
    # event values are small: as they are they show pennies, in units of 1e-5 round and very large amounts
    a = v.activity(spark, d)
    rows = a.select("id", F.lit("as_is").alias("unit"), F.col("amount").alias("x")).unionByName(a.select("id", F.lit("hundred_thousandths").alias("unit"), F.round(F.col("amount") * 1e5).alias("x")))
    out = outliers.amount_sanity(F.col("x"))
    return rows.select("id", "unit", F.array_join(out["flags"], ",").alias("flags"), r(out["risk_score"]).alias("risk_score"), out["is_safe"].alias("is_safe"))


@query(
    "f22_minmax_scaling",
    "SELECT id, round((amount - (SELECT min(amount) FROM activity)) / (SELECT max(amount) - min(amount) FROM activity), 9) AS amount, 0.0::DOUBLE AS constant FROM activity",
    ["activity"],
)
def f22(spark, d):
    rows = v.activity(spark, d).select("id", "amount", F.lit(7.0).alias("constant"))
    return rounded(stats.scaled(rows, ["amount", "constant"], "minmax"), 9)


@query(
    "f23_scalers",
    """
    WITH s AS (SELECT avg(amount) AS m, stddev_pop(amount) AS s, quantile_cont(amount, 0.25) AS q1, median(amount) AS q2, quantile_cont(amount, 0.75) AS q3 FROM activity)
    SELECT id, round((amount - m) / s, 6) AS standard, round((amount - q2) / (q3 - q1), 6) AS robust FROM activity, s
    """,
    ["activity"],
)
def f23(spark, d):
    rows = v.activity(spark, d).select("id", F.col("amount").alias("standard"), F.col("amount").alias("robust"))
    out = stats.scaled(stats.scaled(rows, ["standard"], "standard"), ["robust"], "robust")
    return rounded(out.select("id", "standard", "robust"))


@query(
    "f7_date_parts",
    """
    SELECT id, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS "hour", CAST(month(ts) AS INTEGER) AS "month",
           CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS is_business_hours FROM activity
    """,
    ["activity"],
)
def f7(spark, d):
    return v.activity(spark, d).select("id", *[c.alias(n) for n, c in sc.date_parts(F.col("ts")).items()])


@query(
    "f8_amount_math",
    """
    SELECT id, round(ln(1 + amount), 6) AS log1p, round(amount * amount, 4) AS squared, round(log10(amount), 6) AS log10, round(exp(-amount / 100), 6) AS decay,
           round(CAST(amount AS DECIMAL(20,2)) % 100, 2)::DOUBLE AS mod100, round(CAST(amount AS DECIMAL(20,2)) % 1000, 2)::DOUBLE AS mod1000 FROM activity
    """,
    ["activity"],
)
def f8(spark, d):
    x, m = F.col("amount"), F.col("amount").cast("decimal(20,2)")
    return v.activity(spark, d).select(
        "id", r(F.log1p(x)).alias("log1p"), r(F.pow(x, F.lit(2.0)), 4).alias("squared"), r(F.log10(x)).alias("log10"),
        r(F.exp(-x / 100)).alias("decay"), F.pmod(m, F.lit(100)).cast("double").alias("mod100"),
        F.pmod(m, F.lit(1000)).cast("double").alias("mod1000"),
    )


@query(
    "f9_category_codes",
    """
    WITH p AS (SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)),
         t AS (SELECT doc_id, CASE WHEN quality IS NOT NULL THEN source END AS source FROM p),
         c AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM t WHERE source IS NOT NULL))
    SELECT doc_id, CAST(coalesce(code, -1) AS INTEGER) AS source_code FROM t LEFT JOIN c USING (source)
    """,
)
def f9(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", "source").join(v.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = rows.select("doc_id", F.when(F.col("quality").isNotNull(), F.col("source")).alias("source"))
    return features.category_codes(rows, "source").select("doc_id", "source_code")


@query(
    "f10_fill_missing",
    "SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def f10(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id").join(v.table(spark, d, "labels"), "doc_id", "left")
    return rows.na.fill(0, subset=["quality", "toxic"])


@query(
    "f24_elapsed",
    """
    SELECT o_orderkey, round((epoch_us(max(CAST(l_shipdate AS TIMESTAMP))) - epoch_us(any_value(CAST(o_orderdate AS TIMESTAMP)))) / 1e6, 6) AS elapsed_seconds,
           CAST(CAST(any_value(o_orderdate) AS DATE) + 30 AS VARCHAR) AS target_date FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
    """,
)
def f24(spark, d):
    rows = v.table(spark, d, "orders").join(v.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = rows.groupBy("o_orderkey").agg(F.max(F.col("l_shipdate").cast("timestamp")).alias("e"), F.max(F.col("o_orderdate").cast("timestamp")).alias("s"))
    return out.select("o_orderkey", r(sc.elapsed_seconds(F.col("s"), F.col("e"))).alias("elapsed_seconds"), F.date_add(F.to_date("s"), 30).cast("string").alias("target_date"))


@query(
    "j9_broadcast_statistics",
    """
    WITH s AS (SELECT avg(amount) AS m, stddev_samp(amount) AS s, quantile_cont(amount, 0.9) AS p90 FROM activity)
    SELECT id, round(amount - m, 6) AS centred, amount > p90 AS above_p90 FROM activity, s
    """,
    ["activity"],
)
def j9(spark, d):
    rows = v.activity(spark, d)
    stat = rows.agg(F.avg("amount").alias("m")).crossJoin(F.broadcast(exact_percentiles(rows, [], "amount", {"p90": 0.9}).drop("n")))
    return join_stats(rows, stat, []).select("id", r(F.col("amount") - F.col("m")).alias("centred"), (F.col("amount") > F.col("p90")).alias("above_p90"))


SCORED_SQL = """
    t AS (SELECT d.doc_id, lang, quality, toxic, CAST(abs(hash_k) % 1000 AS DOUBLE) / 1000 AS score, CASE WHEN abs(hash_k) % 1000 >= 600 THEN 1 ELSE 0 END AS predicted
          FROM (SELECT *, (doc_id * 7919 + n_chars) % 1000 AS hash_k FROM documents) d JOIN labels USING (doc_id))
"""


def scored(spark, d):
    """Labelled documents with a score and prediction derived from their keys and lengths."""
    s = (F.col("doc_id") * 7919 + F.col("n_chars")) % 1000
    rows = v.table(spark, d, "documents").select("doc_id", "lang", s.alias("s")).join(v.table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "quality", "toxic", (F.abs("s") / F.lit(1000.0)).alias("score"), (F.abs("s") >= 600).cast("int").alias("predicted"))


@query(
    "a16_confusion",
    f"""WITH {SCORED_SQL},
    c AS (SELECT lang, count(*) FILTER (predicted = 1 AND quality = 1) AS tp, count(*) FILTER (predicted = 0 AND quality = 0) AS tn,
                 count(*) FILTER (predicted = 1 AND quality = 0) AS fp, count(*) FILTER (predicted = 0 AND quality = 1) AS fn FROM t GROUP BY 1),
    p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS "precision", coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM c)
    SELECT lang, tp, tn, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall,
           round(coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0), 6) AS f1_score, tp * 10 + tn - fp * 5 - fn * 20 AS total_reward FROM p""",
)
def a16(spark, d):
    return rounded(evaluation.confusion(scored(spark, d), ["lang"], "predicted", "quality"))


@query(
    "a17_auc",
    f"""WITH {SCORED_SQL},
    w AS (SELECT x.lang, sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS won FROM t x JOIN t y ON x.lang = y.lang AND x.quality = 1 AND y.quality = 0 GROUP BY 1),
    n AS (SELECT lang, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives FROM t GROUP BY 1)
    SELECT lang, positives, negatives, round(won / CAST(nullif(positives * negatives, 0) AS DOUBLE), 6) AS auc FROM n LEFT JOIN w USING (lang)""",
)
def a17(spark, d):
    out = evaluation.auc(scored(spark, d), ["lang"], "score", "quality")
    return rounded(out.withColumn("auc", F.when(F.col("positives") * F.col("negatives") > 0, F.col("auc"))))


@query(
    "a18_threshold_sweep",
    f"""WITH {SCORED_SQL}, g AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold)
    SELECT lang, threshold, CAST(sum(CASE WHEN score >= threshold AND quality = 1 THEN 10 WHEN score < threshold AND quality = 0 THEN 1
           WHEN score >= threshold THEN -5 ELSE -20 END) AS BIGINT) AS total_reward FROM t, g GROUP BY ALL""",
)
def a18(spark, d):
    return evaluation.threshold_sweep(scored(spark, d), ["lang"], "score", "quality", [0.1, 0.3, 0.5, 0.7, 0.9])


@query(
    "a19_score_statistics",
    f"""WITH {SCORED_SQL} SELECT lang, round(avg(CAST(predicted AS DOUBLE)), 6) AS anomaly_rate, max(score) AS max_score, min(score) AS min_score, round(stddev_pop(score), 6) AS score_std,
        round(coalesce(avg(score) FILTER (predicted = 1), 0), 9) AS mean_anomaly_score, round(coalesce(avg(score) FILTER (predicted = 0), 0), 9) AS mean_normal_score,
        round(coalesce(avg(score) FILTER (predicted = 1) - avg(score) FILTER (predicted = 0), 0), 9) AS score_separation FROM t GROUP BY lang""",
)
def a19(spark, d):
    return rounded(evaluation.score_statistics(scored(spark, d), ["lang"], "predicted", "score"), mean_anomaly_score=9, mean_normal_score=9, score_separation=9)


@query(
    "s16_metric_list",
    f"""WITH {SCORED_SQL}, c AS (SELECT lang, count(*) FILTER (predicted = 1 AND toxic = 1) AS tp, count(*) FILTER (predicted = 0 AND toxic = 0) AS tn,
                 count(*) FILTER (predicted = 1 AND toxic = 0) AS fp, count(*) FILTER (predicted = 0 AND toxic = 1) AS fn FROM t GROUP BY 1)
    SELECT lang, 'tp' AS metric, CAST(tp AS DOUBLE) AS "value" FROM c UNION ALL SELECT lang, 'tn', tn FROM c UNION ALL SELECT lang, 'fp', fp FROM c UNION ALL SELECT lang, 'fn', fn FROM c""",
)
def s16(spark, d):
    wide = evaluation.confusion(scored(spark, d), ["lang"], "predicted", "toxic").select("lang", "tp", "tn", "fp", "fn")
    return evaluation.metrics_long(wide, ["lang"])


@query(
    "o23_decision_summary",
    f"""WITH {SCORED_SQL}, x AS (SELECT *, CASE WHEN predicted = 1 AND quality = 1 THEN 10 WHEN predicted = 0 AND quality = 0 THEN 1 WHEN predicted = 1 THEN -5 ELSE -20 END / 20.0::DOUBLE AS reward FROM t)
    SELECT lang, count(*) AS total, count(*) FILTER (predicted = 1) AS total_flags, round(avg(CAST(predicted AS DOUBLE)), 6) AS flag_rate, round(avg(reward), 9) AS average_reward,
           round(least(abs(avg(reward)), 1), 9) AS convergence, round(0.5 + 0.3 * least(abs(avg(reward)), 1), 9) AS adaptive_threshold FROM x GROUP BY lang""",
)
def o23(spark, d):
    p, y = F.col("predicted") == 1, F.col("quality") == 1
    reward = F.when(p & y, 10).when(~p & ~y, 1).when(p, -5).otherwise(-20) / F.lit(20.0)
    return rounded(evaluation.decision_summary(scored(spark, d).withColumn("reward", reward), ["lang"], "predicted", "reward"), average_reward=9, convergence=9, adaptive_threshold=9)
