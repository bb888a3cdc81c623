"""Risk scores, findings, routing, advice, ratios, company risk and scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions.scores import risk_level
from tallyscope.operators import compliance as co
from tallyscope.operators import ratios as ra
from tallyscope.operators import risk as rk
from tallyscope.plans import views as v
from tallyscope.plans.catalog.ledgers import r
from tallyscope.plans.catalog.measures import rounded
from tallyscope.plans.catalog.rules import COLUMNS as RULE_COLUMNS
from tallyscope.plans.catalog.rules import CONTROLS_SQL, RATES_SQL, controls
from tallyscope.plans.registry import query

FR = """least(greatest((CASE severity WHEN 'critical' THEN 0.9 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.5 ELSE 0.3 END
    + CASE WHEN coalesce(financial_impact, 0) <> 0 THEN least(0.3, log10(greatest(financial_impact, 1)) / 10) ELSE 0 END
    + CASE WHEN regulatory_reference IS NOT NULL THEN 0.1 ELSE 0 END) * (0.5 + confidence * 0.5), 0), 1)"""
AR = "confidence * CASE severity WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.3 ELSE 0.1 END"
CALC = "CASE WHEN {x} >= 0.85 THEN 'critical' WHEN {x} >= 0.7 THEN 'high' WHEN {x} >= 0.5 THEN 'medium' ELSE 'low' END"
ITEMS_SQL = f"it AS (SELECT session_id, 'finding' AS source, {FR} AS risk FROM findings UNION ALL SELECT session_id, 'anomaly', {AR} FROM anomalies)"
PORT_SQL = ITEMS_SQL + f""",
    cc AS (SELECT session_id, category, count(*) AS c FROM findings GROUP BY 1, 2),
    cs AS (SELECT session_id, least(greatest(max(c) / CAST(sum(c) AS DOUBLE) - 0.5, 0) * 0.4, 0.2) AS concentration_risk FROM cc GROUP BY 1),
    ps AS (SELECT session_id, count(*) FILTER (source = 'finding') AS finding_count, count(*) FILTER (source = 'anomaly') AS anomaly_count,
                  coalesce(max(risk) FILTER (source = 'finding'), 0) AS max_finding_risk, coalesce(avg(risk) FILTER (source = 'finding'), 0) AS avg_finding_risk,
                  coalesce(max(risk) FILTER (source = 'anomaly'), 0) AS max_anomaly_risk, coalesce(avg(risk) FILTER (source = 'anomaly'), 0) AS avg_anomaly_risk FROM it GROUP BY 1),
    pf AS (SELECT ps.*, coalesce(concentration_risk, 0) AS concentration_risk,
                  least(1, max_finding_risk * 0.4 + avg_finding_risk * 0.2 + max_anomaly_risk * 0.3 + avg_anomaly_risk * 0.1 + coalesce(concentration_risk, 0)) AS portfolio_risk_score
           FROM ps LEFT JOIN cs USING (session_id))
"""
FA = ["findings", "anomalies"]


def _fa(spark, d):
    return v.findings(spark, d), v.anomalies(spark, d)


@query("r5_finding_risk", f"SELECT finding_id, round({FR}, 6) AS risk FROM findings", ["findings"])
def r5(spark, d):
    return v.findings(spark, d).select("finding_id", r(rk.finding_risk()).alias("risk"))


@query("u2_risk_items", f"WITH {ITEMS_SQL} SELECT session_id, source, count(*) AS n, round(sum(risk), 6) AS total FROM it GROUP BY 1, 2", FA)
def u2(spark, d):
    return rk.item_risks(*_fa(spark, d), ["session_id"]).groupBy("session_id", "source").agg(F.count(F.lit(1)).alias("n"), r(F.sum("risk")).alias("total"))


@query("a14_concentration", f"WITH {PORT_SQL} SELECT session_id, round(concentration_risk, 6) AS concentration_risk FROM cs", FA)
def a14(spark, d):
    return rounded(rk.concentration(v.findings(spark, d), ["session_id"]))


@query(
    "a15_level_histogram",
    f"""WITH {ITEMS_SQL}, l AS (SELECT session_id, {CALC.format(x='risk')} AS level FROM it)
    SELECT s.session_id, x.level, count(l.level) AS n FROM (SELECT DISTINCT session_id FROM it) s CROSS JOIN (SELECT unnest(['low', 'medium', 'high', 'critical']) AS level) x
    LEFT JOIN l ON l.session_id = s.session_id AND l.level = x.level GROUP BY 1, 2""",
    FA,
)
def a15(spark, d):
    return rk.level_histogram(rk.item_risks(*_fa(spark, d), ["session_id"]), ["session_id"])


@query(
    "r6_portfolio_risk",
    f"""WITH {PORT_SQL} SELECT session_id, finding_count, anomaly_count, round(max_finding_risk, 6) AS max_finding_risk, round(avg_finding_risk, 9) AS avg_finding_risk, round(max_anomaly_risk, 6) AS max_anomaly_risk,
        round(avg_anomaly_risk, 9) AS avg_anomaly_risk, round(concentration_risk, 6) AS concentration_risk, round(portfolio_risk_score, 9) AS portfolio_risk_score, {CALC.format(x='portfolio_risk_score')} AS risk_level FROM pf""",
    FA,
)
def r6(spark, d):
    return rounded(rk.portfolio(*_fa(spark, d), ["session_id"]), avg_finding_risk=9, avg_anomaly_risk=9, portfolio_risk_score=9)


@query(
    "a10_findings_summary",
    """
    WITH t AS (SELECT session_id, count(*) AS total_findings, count(*) FILTER (severity IN ('high', 'critical')) AS critical_count, count(*) FILTER (severity = 'medium') AS medium_count FROM findings GROUP BY 1),
         k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, finding_id) AS rank FROM findings),
         l AS (SELECT session_id, string_agg(title || ':' || left(description, 200), '|' ORDER BY rank) AS top_findings FROM k WHERE rank <= 5 GROUP BY 1)
    SELECT * FROM t JOIN l USING (session_id)
    """,
    ["findings"],
)
def a10(spark, d):
    f = v.findings(spark, d)
    item = F.struct("rank", F.concat_ws(":", F.col("title"), F.substring("description", 1, 200)).alias("x"))
    top = rk.top_findings(f, ["session_id"]).groupBy("session_id").agg(F.sort_array(F.collect_list(item)).alias("t"))  # five entries
    top = top.select("session_id", F.array_join(F.transform("t", lambda s: s["x"]), "|").alias("top_findings"))
    return rk.finding_totals(f, ["session_id"]).join(top, "session_id")


@query(
    "t2_top_findings",
    "SELECT session_id, finding_id, severity, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, finding_id) AS rank FROM findings) WHERE rank <= 5",
    ["findings"],
)
def t2(spark, d):
    return rk.top_findings(v.findings(spark, d), ["session_id"]).select("session_id", "finding_id", "severity", "rank")


@query(
    "a11_anomaly_summary",
    """
    SELECT session_id, count(*) AS total_anomalies, count(*) FILTER (confidence > 0.8) AS high_confidence_count, count(*) FILTER (type = 'statistical_deviation') AS statistical_anomalies,
           count(*) FILTER (type = 'rl_anomaly') AS rl_detected_anomalies, round(avg(confidence), 9) AS avg_confidence FROM anomalies GROUP BY session_id
    """,
    ["anomalies"],
)
def a11(spark, d):
    return rounded(rk.anomaly_totals(v.anomalies(spark, d), ["session_id"]), 9)


@query(
    "t3_top_anomalies",
    "SELECT session_id, anomaly_id, confidence, left(description, 150) AS description, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, anomaly_id) AS rank FROM anomalies) WHERE rank <= 3",
    ["anomalies"],
)
def t3(spark, d):
    return rk.top_anomalies(v.anomalies(spark, d), ["session_id"]).select("session_id", "anomaly_id", "confidence", F.substring("description", 1, 150).alias("description"), "rank")


@query(
    "p8_high_severity",
    "SELECT 'finding' AS source, finding_id AS id FROM findings WHERE severity IN ('high', 'critical') UNION ALL SELECT 'anomaly', anomaly_id FROM anomalies WHERE confidence > 0.7",
    FA,
)
def p8(spark, d):
    f, a = _fa(spark, d)
    return f.where(F.col("severity").isin("high", "critical")).select(F.lit("finding").alias("source"), F.col("finding_id").alias("id")).unionByName(
        a.where(F.col("confidence") > 0.7).select(F.lit("anomaly").alias("source"), F.col("anomaly_id").alias("id"))
    )


SIGNAL_SQL = PORT_SQL + """,
    sv AS (SELECT session_id, count(*) FILTER (severity IN ('high', 'critical')) AS severe FROM findings GROUP BY 1),
    sa AS (SELECT session_id, count(*) FILTER (confidence > 0.8) AS sure FROM anomalies GROUP BY 1),
    sg AS (SELECT session_id, portfolio_risk_score AS s, coalesce(severe, 0) AS f, coalesce(sure, 0) AS a FROM pf LEFT JOIN sv USING (session_id) LEFT JOIN sa USING (session_id))
"""


def _signals(spark, d):
    f, a = _fa(spark, d)
    return rk.session_signals(rk.portfolio(f, a, ["session_id"]), f, a, ["session_id"])


@query(
    "r7_routing",
    f"WITH {SIGNAL_SQL} SELECT session_id, CASE WHEN s >= 0.8 OR f >= 3 OR a >= 5 THEN 'deep_dive' WHEN s >= 0.5 OR f >= 1 OR a >= 2 THEN 'human_review' ELSE 'generate_report' END AS route FROM sg",
    FA,
)
def r7(spark, d):
    return _signals(spark, d).select("session_id", rk.route(F.col("portfolio_risk_score"), F.col("severe_findings"), F.col("confident_anomalies")).alias("route"))


@query(
    "r8_urgency",
    f"WITH {SIGNAL_SQL} SELECT session_id, CASE WHEN s > 0.8 OR f >= 3 THEN 'urgent' WHEN s > 0.5 OR f >= 1 OR a >= 2 THEN 'high' WHEN s > 0.3 OR a >= 1 THEN 'medium' ELSE 'low' END AS urgency FROM sg",
    FA,
)
def r8(spark, d):
    return _signals(spark, d).select("session_id", rk.urgency(F.col("portfolio_risk_score"), F.col("severe_findings"), F.col("confident_anomalies")).alias("urgency"))


STATUS_SQL = """st AS (SELECT session_id, CASE WHEN bool_or(severity = 'critical') THEN 'NON_COMPLIANT' WHEN bool_or(severity = 'high') THEN 'CONDITIONALLY_COMPLIANT' ELSE 'COMPLIANT' END AS compliance_status FROM findings GROUP BY 1)"""


@query("r9_compliance_status", f"WITH {STATUS_SQL} SELECT * FROM st", ["findings"])
def r9(spark, d):
    return rk.compliance_status(v.findings(spark, d), ["session_id"])


STEPS = ["initialize", "ingest_and_parse", "statistical_analysis", "regulatory_validation", "rl_anomaly_detection", "consolidate_results", "human_review_mcp", "deep_dive_investigation", "generate_report"]
STEP_SQL = "stp AS (SELECT account_id AS session_id, ts, id, [" + ", ".join(f"'{s}'" for s in STEPS) + "][k % 9 + 1] AS step FROM activity)"


def steps_of(activity):
    """Workflow steps of the sessions, one for each event."""
    names = F.array(*[F.lit(s) for s in STEPS])
    return activity.select(F.col("account_id").alias("session_id"), "ts", "id", F.element_at(names, F.col("k") % 9 + 1).alias("step"))


def steps(spark, d):
    return steps_of(v.activity(spark, d))


@query(
    "r16_session_rollup",
    f"""WITH {SIGNAL_SQL}, {STATUS_SQL}, {STEP_SQL}, pr AS (SELECT session_id, count(DISTINCT step) AS steps_completed FROM stp GROUP BY 1)
    SELECT pf.session_id, finding_count AS findings, f AS severe_findings, round(portfolio_risk_score, 9) AS risk_score, compliance_status, CAST(coalesce(steps_completed, 0) AS INTEGER) AS steps_completed,
           round(coalesce(steps_completed, 0) / 9.0::DOUBLE * 100, 6) AS progress_percentage FROM pf JOIN sg USING (session_id) LEFT JOIN st USING (session_id) LEFT JOIN pr USING (session_id)""",
    ["findings", "anomalies", "activity"],
)
def r16(spark, d):
    from tallyscope.operators.sessions import progress

    pr = progress(steps(spark, d), ["session_id"], "step", "ts").drop("current_step")
    out = _signals(spark, d).join(rk.compliance_status(v.findings(spark, d), ["session_id"]), "session_id", "left").join(pr, "session_id", "left")
    return out.select("session_id", F.col("finding_count").alias("findings"), "severe_findings", r("portfolio_risk_score", 9).alias("risk_score"), "compliance_status",
                      F.coalesce("steps_completed", F.lit(0)).alias("steps_completed"), r(F.coalesce("progress_percentage", F.lit(0.0))).alias("progress_percentage"))


METHODS = ["benford_1", "benford_2", "zipf", "isolation_forest", "pyod_ensemble", "reinforcement_learning"]
SCORES_SQL = "msc AS (SELECT account_id AS session_id, [" + ", ".join(f"'{m}'" for m in METHODS) + "][k % 6 + 1] AS method, round(sum(k) / (count(*) * 100.0::DOUBLE) + 0.35::DOUBLE * (account_id % 2), 9) AS score FROM activity GROUP BY 1, 2, account_id)"
WEIGHTS_SQL = "wt(method, w, c) AS (VALUES ('benford_1', 0.25, 0.9), ('benford_2', 0.15, 0.9), ('zipf', 0.15, 0.8), ('isolation_forest', 0.20, 0.85), ('pyod_ensemble', 0.25, 1.0), ('reinforcement_learning', 0.30, 0.5))"
MR_SQL = f"""{SCORES_SQL}, {WEIGHTS_SQL},
    mr AS (SELECT session_id, least(greatest(CAST(sum(CAST(score AS DECIMAL(18,9)) * CAST(w AS DECIMAL(9,4))) AS DOUBLE), 0), 1) AS overall, avg(c) AS conf, count(*) AS methods_used FROM msc JOIN wt USING (method) GROUP BY 1),
    ml AS (SELECT *, CASE WHEN overall >= 0.8 THEN 'critical' WHEN overall >= 0.6 THEN 'high' WHEN overall >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM mr)
"""


def method_scores(spark, d):
    """Method scores per account, averaged from the events: one division of whole sums, so row order cannot move a score."""
    names = F.array(*[F.lit(m) for m in METHODS])
    a = v.activity(spark, d)
    sums = a.groupBy(F.col("account_id").alias("session_id"), F.element_at(names, F.col("k") % 6 + 1).alias("method")).agg(
        F.sum("k").alias("s"), F.count(F.lit(1)).alias("n")
    )
    mean = F.col("s") / (F.col("n") * F.lit(100.0))
    return sums.select("session_id", "method", F.round(mean + F.lit(0.35) * (F.col("session_id") % 2), 9).alias("score"))


@query("r1_method_risk", f"WITH {MR_SQL} SELECT session_id, round(overall, 9) AS overall_risk_score, round(conf, 9) AS confidence_score, methods_used, risk_level FROM ml", ["activity"])
def r1(spark, d):
    return rounded(rk.method_risk(method_scores(spark, d), ["session_id"]), 9)


@query(
    "r2_composite_score",
    f"WITH {SCORES_SQL}, {WEIGHTS_SQL} SELECT session_id, round(least(greatest(CASE WHEN abs(sum(w) - 1) > 0.01 THEN CAST(sum(CAST(score AS DECIMAL(18,9)) * CAST(w AS DECIMAL(9,4))) AS DOUBLE) / CAST(sum(CAST(w AS DECIMAL(9,4))) AS DOUBLE) ELSE CAST(sum(CAST(score AS DECIMAL(18,9)) * CAST(w AS DECIMAL(9,4))) AS DOUBLE) END, 0), 1), 9) AS composite_score FROM msc JOIN wt USING (method) GROUP BY 1",
    ["activity"],
)
def r2(spark, d):
    rows = method_scores(spark, d).join(F.broadcast(rk.method_dimension(spark)), "method")
    return rounded(rk.composite(rows, ["session_id"], "score", "weight"), 9)


@query(
    "r3_level_scales",
    """
    SELECT id, CASE WHEN k >= 90 THEN 'critical' WHEN k >= 80 THEN 'high' WHEN k >= 60 THEN 'medium' ELSE 'low' END AS utility, CASE WHEN k >= 85 THEN 'critical' WHEN k >= 70 THEN 'high' WHEN k >= 50 THEN 'medium' ELSE 'low' END AS calculator,
           CASE WHEN k >= 80 THEN 'critical' WHEN k >= 60 THEN 'high' WHEN k >= 40 THEN 'medium' ELSE 'low' END AS workflow, CASE WHEN k >= 80 THEN 'critical' WHEN k >= 50 THEN 'high' WHEN k >= 20 THEN 'medium' ELSE 'low' END AS assessment FROM activity
    """,
    ["activity"],
)
def r3(spark, d):
    x = F.col("k") / F.lit(100.0)
    return v.activity(spark, d).select("id", *[risk_level(x, s).alias(s) for s in ("utility", "calculator", "workflow", "assessment")])


@query(
    "r4_overall_risk",
    """
    WITH s AS (SELECT account_id AS session_id, count(*) AS n, count(*) FILTER (k < 4) AS vi, count(*) FILTER (k > 97) AS an, sum(k) / (count(*) * 100.0::DOUBLE) AS p FROM activity GROUP BY 1),
    x AS (SELECT *, CASE WHEN p <= 0 THEN 1 WHEN p >= 1 THEN 0 ELSE 1 - exp(-5 * (1 - p)) END AS st, CASE WHEN vi / n::DOUBLE >= 0.1 THEN 1 ELSE least(vi / n::DOUBLE * 10, 1) END AS rg,
          CASE WHEN an / n::DOUBLE <= 0.02 THEN an / n::DOUBLE / 0.02 * 0.3 ELSE 0.3 + least(0.7, (an / n::DOUBLE - 0.02) * 20) END AS ar,
          CASE WHEN n < 10 THEN 0.7 WHEN n < 100 THEN 0.3 WHEN n > 10000 THEN 0.4 ELSE 0.1 END AS vo FROM s)
    SELECT session_id, round(least(greatest(st * 0.25 + rg * 0.30 + ar * 0.25 + vo * 0.10 + 0.1 * 0.2 + 0.05 * 0.5, 0), 1), 6) AS overall_risk FROM x
    """,
    ["activity"],
)
def r4(spark, d):
    k = F.col("k")
    s = v.activity(spark, d).groupBy(F.col("account_id").alias("session_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(k < 4).alias("vi"), F.count_if(k > 97).alias("an"), (F.sum(k) / (F.count(F.lit(1)) * F.lit(100.0))).alias("p")
    )
    extra = {"trend_analysis": F.lit(0.2), "other": F.lit(0.5)}
    return s.select("session_id", r(rk.overall_risk(F.col("p"), F.col("vi"), F.col("an"), F.col("n"), extra)).alias("overall_risk"))


@query(
    "r10_generated_findings",
    f"""WITH {MR_SQL} SELECT session_id AS audit_session_id, 'Statistical Analysis' AS category, risk_level AS severity, 'Comprehensive Statistical Anomaly Analysis' AS title, 'SOX Section 404, PCAOB AS 2201' AS regulatory_reference, round(conf, 9) AS confidence_score FROM ml
    UNION ALL SELECT session_id, 'Statistical Analysis - ' || nm, CASE WHEN score > 0.8 THEN 'high' ELSE 'medium' END, 'High Risk Detected by ' || nm, 'PCAOB AS 2301 - Audit Evidence', round(score, 9)
    FROM msc JOIN (VALUES ('benford_1', 'Benford 1'), ('benford_2', 'Benford 2'), ('zipf', 'Zipf'), ('isolation_forest', 'Isolation Forest'), ('pyod_ensemble', 'Pyod Ensemble'), ('reinforcement_learning', 'Reinforcement Learning')) t(method, nm) USING (method) WHERE score > 0.7""",
    ["activity"],
)
def r10(spark, d):
    scores = method_scores(spark, d)
    return rounded(rk.generated_findings(rk.method_risk(scores, ["session_id"]), scores, "session_id"), 9)


@query(
    "r11_risk_factors",
    f"""WITH {MR_SQL}, m AS (SELECT session_id, greatest(max(score) FILTER (method = 'benford_1'), max(score) FILTER (method = 'benford_2')) AS b, max(score) FILTER (method = 'zipf') AS z, max(score) FILTER (method = 'isolation_forest') AS i,
        max(score) FILTER (method = 'pyod_ensemble') AS p, max(score) FILTER (method = 'reinforcement_learning') AS rl, any_value(overall) AS o FROM msc JOIN ml USING (session_id) GROUP BY 1),
    f AS (SELECT session_id, concat_ws('|', CASE WHEN b > 0.6 THEN 'Unusual digit distribution patterns' END, CASE WHEN z > 0.6 THEN 'Atypical text patterns' END, CASE WHEN i > 0.7 THEN 'Statistical outliers detected' END,
        CASE WHEN p > 0.7 THEN 'Multiple ML methods agree on anomalies' END, CASE WHEN rl > 0.7 THEN 'Adaptive AI flagged unusual patterns' END, CASE WHEN o > 0.8 THEN 'Multiple detection methods in agreement' END) AS factors FROM m)
    SELECT * FROM f WHERE factors <> ''""",
    ["activity"],
)
def r11(spark, d):
    scores = method_scores(spark, d)
    name = F.when(F.col("method").startswith("benford"), "benford").otherwise(F.col("method"))
    metrics = scores.select("session_id", name.alias("metric"), F.col("score").alias("value")).unionByName(
        rk.method_risk(scores, ["session_id"]).select("session_id", F.lit("overall").alias("metric"), F.col("overall_risk_score").alias("value"))
    )
    return rk.advise(metrics, ["session_id"], "risk_factors").select("session_id", F.array_join("texts", "|").alias("factors"))


@query(
    "r11_portfolio_advice",
    f"""WITH {PORT_SQL}, l AS (SELECT *, {CALC.format(x='portfolio_risk_score')} AS lv FROM pf)
    SELECT session_id, concat_ws('|', CASE lv WHEN 'critical' THEN 'Immediate escalation to senior management required|Consider suspending related transactions pending investigation|Engage external audit specialists if needed'
        WHEN 'high' THEN 'Prioritize investigation of high-risk findings|Implement enhanced monitoring controls|Schedule follow-up review within 30 days'
        WHEN 'medium' THEN 'Review and validate medium-risk findings|Consider implementing additional controls|Monitor for trend development' ELSE 'Continue routine monitoring and controls' END,
        CASE WHEN concentration_risk > 0.1 THEN 'Address concentration of issues in specific areas' END, CASE WHEN finding_count > 10 THEN 'Consider process improvements to reduce finding frequency' END,
        CASE WHEN max_finding_risk > 0.8 THEN 'Focus immediate attention on highest-risk finding' END) AS advice FROM l""",
    FA,
)
def r11_portfolio(spark, d):
    p = rk.portfolio(*_fa(spark, d), ["session_id"])
    wide = p.select(
        "session_id", F.col("concentration_risk").cast("double"), F.col("finding_count").cast("double").alias("finding_count"), F.col("max_finding_risk").cast("double"),
        *[(F.col("risk_level") == n).cast("double").alias(f"level_{n}") for n in ("low", "medium", "high", "critical")],
    )
    metrics = wide.unpivot(["session_id"], [c for c in wide.columns if c != "session_id"], "metric", "value")
    return rk.advise(metrics, ["session_id"], "portfolio").select("session_id", F.array_join("texts", "|").alias("advice"))


NEXT_SQL = """CASE risk_level WHEN 'critical' THEN ['pause_workflow', 'trigger_human_review_mcp', 'escalate_to_management', 'prepare_emergency_report'] WHEN 'high' THEN ['trigger_human_review_mcp', 'deep_dive_investigation', 'expand_sample_size', 'additional_testing']
    WHEN 'medium' THEN ['flag_for_review', 'continue_standard_procedures', 'monitor_trends', 'document_findings'] ELSE ['continue_standard_procedures', 'document_findings', 'proceed_to_next_phase'] END"""


@query(
    "u3_next_steps",
    f"""WITH {MR_SQL} SELECT session_id, unnest({NEXT_SQL}) AS step FROM ml
    UNION SELECT session_id, 'detailed_digit_analysis' FROM msc WHERE method IN ('benford_1', 'benford_2') AND score > 0.7
    UNION SELECT session_id, 'anomaly_investigation' FROM msc WHERE method IN ('isolation_forest', 'pyod_ensemble') AND score > 0.7
    UNION SELECT session_id, 'adaptive_model_review' FROM msc WHERE method = 'reinforcement_learning' AND score > 0.7""",
    ["activity"],
)
def u3(spark, d):
    scores = method_scores(spark, d)
    return rk.next_steps(rk.method_risk(scores, ["session_id"]), scores, "session_id")


LEVEL_SQL = """CASE risk_level WHEN 'critical' THEN 'IMMEDIATE ACTION REQUIRED|Halt processing and conduct emergency review|Escalate to senior management and compliance team|Consider external forensic audit'
    WHEN 'high' THEN 'Urgent review required within 24 hours|Increase sampling and testing procedures|Implement additional controls'
    WHEN 'medium' THEN 'Schedule detailed review within one week|Monitor closely for trend development|Consider additional testing' ELSE 'Continue standard monitoring procedures|Document findings for trend analysis' END"""


@query(
    "r11_comprehensive_advice",
    f"""WITH {MR_SQL}, h AS (SELECT session_id, string_agg(method, ', ' ORDER BY method) AS m FROM msc WHERE score > 0.7 GROUP BY 1)
    SELECT session_id, concat_ws('|', 'Overall risk level: ' || upper(risk_level), 'Comprehensive risk score: ' || format('{{:.2f}}', overall), 'High risk detected by: ' || m, {LEVEL_SQL}) AS advice FROM ml LEFT JOIN h USING (session_id)""",
    ["activity"],
)
def r11_comprehensive(spark, d):
    scores = method_scores(spark, d)
    out = rk.comprehensive_advice(rk.method_risk(scores, ["session_id"]), scores, "session_id")
    return out.select("session_id", F.array_join("recommendations", "|").alias("advice"))


@query(
    "r11_recommendations",
    f"""WITH {MR_SQL}, q(trigger_name, priority, title) AS (VALUES ('severe_level', 'CRITICAL', 'Emergency Review Required'), ('benford_1', 'HIGH', 'Benford''s Law Deviation Investigation'), ('benford_2', 'HIGH', 'Benford''s Law Deviation Investigation'),
        ('isolation_forest', 'HIGH', 'Statistical Outlier Investigation'), ('pyod_ensemble', 'HIGH', 'Statistical Outlier Investigation'), ('reinforcement_learning', 'MEDIUM', 'AI-Detected Behavioral Anomalies'),
        ('low_success', 'MEDIUM', 'Improve Data Quality for Analysis'), ('always', 'LOW', 'Establish Ongoing Statistical Monitoring')),
    f AS (SELECT session_id, 'severe_level' AS trigger_name FROM ml WHERE risk_level IN ('critical', 'high') UNION ALL SELECT session_id, method FROM msc WHERE score > 0.7
          UNION ALL SELECT session_id, 'low_success' FROM ml WHERE methods_used / 6.0::DOUBLE < 0.8 UNION ALL SELECT session_id, 'always' FROM ml)
    SELECT session_id, priority, title, row_number() OVER (PARTITION BY session_id ORDER BY CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, trigger_name) AS rank FROM f JOIN q USING (trigger_name)""",
    ["activity"],
)
def r11_recommendations(spark, d):
    scores = method_scores(spark, d)
    success = scores.groupBy("session_id").agg((F.count(F.lit(1)) / F.lit(6.0)).alias("success_rate"))
    out = rk.recommendations(rk.method_risk(scores, ["session_id"]), scores, success, "session_id")
    return out.select("session_id", "priority", "title", "rank")


@query(
    "t7_prioritized",
    """
    WITH p AS (SELECT session_id, title, CASE severity WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM findings)
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, title) AS rank FROM p
    """,
    ["findings"],
)
def t7(spark, d):
    return rk.prioritized(v.findings(spark, d).select("session_id", "title", F.upper("severity").alias("priority")), ["session_id"])


@query(
    "t11_severe_recommendations",
    "SELECT session_id, recommendation, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY finding_id) AS rank FROM findings WHERE severity IN ('high', 'critical')) WHERE rank <= 10",
    ["findings"],
)
def t11(spark, d):
    return rk.high_severity_recommendations(v.findings(spark, d), ["session_id"])


# ---- statements -------------------------------------------------------------------------------

RATIO_SQL = "rat AS (SELECT supplier_id, fiscal_year, unnest(['" + "', '".join(ra.RATIOS) + "']) AS ratio, unnest([" + ", ".join(f"{a} / nullif({b}, 0)" for a, b in ra.RATIOS.values()) + "]) AS value FROM statements)"


@query("r12_financial_ratios", f"WITH {RATIO_SQL} SELECT supplier_id, fiscal_year, ratio, round(value, 6) AS value FROM rat WHERE value IS NOT NULL", ["statements"])
def r12(spark, d):
    return rounded(ra.long_ratios(v.statements(spark, d), ["supplier_id", "fiscal_year"]))


@query(
    "j6_benchmark_flags",
    f"""WITH {RATIO_SQL}, bm AS (SELECT ratio, quantile_cont(value, 0.1) AS lo, median(value) AS md, quantile_cont(value, 0.9) AS hi FROM rat WHERE value IS NOT NULL GROUP BY 1),
    x AS (SELECT supplier_id, fiscal_year, ratio, value, lo, md, hi FROM rat JOIN bm USING (ratio) WHERE value IS NOT NULL)
    SELECT supplier_id, fiscal_year, ratio, round(value, 6) AS value, 'below_minimum' AS flag FROM x WHERE value < lo UNION ALL SELECT supplier_id, fiscal_year, ratio, round(value, 6), 'above_maximum' FROM x WHERE value > hi
    UNION ALL SELECT supplier_id, fiscal_year, ratio, round(value, 6), 'far_from_median' FROM x WHERE abs(value - md) / md > 0.5""",
    ["statements"],
)
def j6(spark, d):
    from tallyscope.operators.quantiles import exact_percentiles

    long = ra.long_ratios(v.statements(spark, d), ["supplier_id", "fiscal_year"])
    bench = exact_percentiles(long, ["ratio"], "value", {"min": 0.1, "median": 0.5, "max": 0.9}).drop("n")  # one row per ratio
    return rounded(ra.benchmark_flags(long, bench, ["supplier_id", "fiscal_year"]))


@query(
    "r13_ratio_warnings",
    """
    WITH x AS (SELECT supplier_id, fiscal_year, coalesce(total_liabilities / nullif(total_assets, 0), 0) > 0.8 AS h, coalesce(current_assets / nullif(current_liabilities, 0), 0) < 1 AS l FROM statements)
    SELECT supplier_id, fiscal_year, concat_ws(',', CASE WHEN h THEN 'high_debt_to_assets' END, CASE WHEN l THEN 'low_current_ratio' END) AS warnings, round((h::INT + l::INT) * 0.3::DOUBLE, 6) AS risk_score FROM x
    """,
    ["statements"],
)
def r13(spark, d):
    out = ra.ratio_warnings(v.statements(spark, d))
    return out.select("supplier_id", "fiscal_year", F.array_join("warnings", ",").alias("warnings"), r(F.col("risk_score").cast("double")).alias("risk_score"))


COMPANY_SQL = """
    op AS (SELECT supplier_id, fiscal_year, max(CAST(c AS DOUBLE)) / sum(CAST(c AS DOUBLE)) AS conc FROM (SELECT supplier_id, year(transaction_date) AS fiscal_year, account_code, sum(amount) AS c FROM ledger GROUP BY ALL) GROUP BY 1, 2),
    co AS (SELECT s.*, conc, revenue / total_assets AS vr, (supplier_id % 10) / 10.0::DOUBLE AS fr FROM statements s JOIN op USING (supplier_id, fiscal_year)),
    sc AS (SELECT *, round((CASE WHEN total_liabilities / nullif(total_equity, 0) > 2 THEN 0.3 ELSE 0 END + CASE WHEN interest_expense > 0 AND ebit / interest_expense < 2.5 THEN 0.4 ELSE 0 END
              + CASE WHEN current_assets / nullif(current_liabilities, 0) < 1 THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS credit,
           round((CASE WHEN conc > 0.3 THEN 0.4 ELSE 0 END + CASE WHEN fr > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN supplier_id % 3 = 0 THEN 0.3 ELSE 0 END + CASE WHEN fiscal_year % 2 = 0 THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS operational,
           round((CASE WHEN vr > 0.95 THEN 0.3 ELSE 0 END + CASE WHEN fr > 0.3 THEN 0.2 ELSE 0 END + CASE WHEN supplier_id % 4 = 0 THEN 0.2 ELSE 0 END + CASE WHEN vr * 1.6 > 1.5 THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS market FROM co)
"""


def company(spark, d):
    """Statements with concentration and market columns derived from the ledger."""
    by_account = v.ledger(spark, d, "supplier_id", "transaction_date", "account_code", "amount").groupBy("supplier_id", F.year("transaction_date").alias("fiscal_year"), "account_code").agg(
        F.sum("amount").cast("double").alias("c")
    )
    conc = by_account.groupBy("supplier_id", "fiscal_year").agg((F.max("c") / F.sum("c")).alias("customer_concentration"))
    rows = v.statements(spark, d).join(conc, ["supplier_id", "fiscal_year"])
    foreign = (F.col("supplier_id") % 10) / F.lit(10.0)
    share = F.col("revenue") / F.col("total_assets")
    return rows.select(
        "*", foreign.alias("geographic_concentration"), foreign.alias("foreign_revenue_pct"), (F.col("supplier_id") % 3 == 0).alias("key_personnel_risk"),
        (F.col("fiscal_year") % 2 == 0).alias("regulatory_changes"), (share - 0.45).alias("variable_rate_debt_pct"), (F.col("supplier_id") % 4 == 0).alias("commodity_exposure"), (share * 1.6).alias("beta"),
    )


LEVEL = "CASE WHEN {x} >= 0.8 THEN 'Critical' WHEN {x} >= 0.5 THEN 'High' WHEN {x} >= 0.2 THEN 'Medium' ELSE 'Low' END"


@query(
    "r14_company_risk",
    f"WITH {COMPANY_SQL} SELECT supplier_id, fiscal_year, " + ", ".join(f"least({c}, 1) AS {c}_risk_score, {LEVEL.format(x=c)} AS {c}_risk_level" for c in ("credit", "operational", "market")) + " FROM sc",
    ["statements", "ledger"],
)
def r14(spark, d):
    out = ra.market_risk(ra.operational_risk(ra.credit_risk(company(spark, d))))
    return rounded(out.select("supplier_id", "fiscal_year", *[f"{c}_{s}" for c in ("credit", "operational", "market") for s in ("risk_score", "risk_level")]))


@query(
    "r15_stress_scenarios",
    """
    WITH sn(scenario, rc, ci, ir, dr, av) AS (VALUES ('economic_downturn', -0.25, 0.15, 0, 0, 0), ('interest_rate_shock', 0, 0, 0.03, 0.02, 0), ('market_crash', 0, 0, 0, 0, -0.40)),
    x AS (SELECT supplier_id, fiscal_year, scenario, revenue * (1 + rc::DOUBLE) AS sr, expenses * (1 + ci::DOUBLE) + coalesce(total_liabilities, 0) * (ir::DOUBLE + dr::DOUBLE) AS se, total_assets * (1 + av::DOUBLE) AS sa FROM statements, sn)
    SELECT supplier_id, fiscal_year, scenario, round(sr, 6) AS stressed_revenue, round(se, 6) AS stressed_expenses, round(sa, 6) AS stressed_assets, round(sr - se, 6) AS stressed_net_income FROM x
    """,
    ["statements"],
)
def r15(spark, d):
    out = ra.stress(v.statements(spark, d).withColumn("total_liabilities", F.coalesce("total_liabilities", F.lit(0.0))))
    return rounded(out.select("supplier_id", "fiscal_year", "scenario", "stressed_revenue", "stressed_expenses", "stressed_assets", "stressed_net_income"))


@query(
    "w11_latest_statement",
    "SELECT supplier_id, max(fiscal_year) AS fiscal_year, round(arg_max(revenue, fiscal_year), 4) AS revenue, round(arg_max(total_assets, fiscal_year), 2) AS total_assets FROM statements GROUP BY supplier_id",
    ["statements"],
)
def w11(spark, d):
    return rounded(ra.latest_per(v.statements(spark, d), ["supplier_id"], "fiscal_year", "revenue", "total_assets"), revenue=4, total_assets=2)


BY_SUPPLIER = RATES_SQL.replace("session_id", "supplier_id")


@query(
    "r18_scorecards",
    f"""WITH {COMPANY_SQL}, {BY_SUPPLIER},
    lt AS (SELECT supplier_id, arg_max(least(credit, 1), fiscal_year) AS credit_risk, arg_max(least(operational, 1), fiscal_year) AS operational_risk, arg_max(least(market, 1), fiscal_year) AS market_risk FROM sc GROUP BY 1),
    fr AS (SELECT supplier_id, max(compliance_rate) FILTER (regulation = 'SOX') AS sox, max(compliance_rate) FILTER (regulation = 'GAAP') AS gaap, max(compliance_rate) FILTER (regulation = 'IFRS') AS ifrs, avg(compliance_rate) AS mean_rate FROM rates GROUP BY 1),
    rd AS (SELECT supplier_id, count(*) FILTER (amount % 100 = 0) / CAST(count(*) AS DOUBLE) AS fraud_risk FROM ledger GROUP BY 1)
    SELECT supplier_id, credit_risk, operational_risk, market_risk, round(1 - mean_rate, 6) AS compliance_risk, round(fraud_risk, 6) AS fraud_risk, round(sox * 100, 6) AS sox_score, round(gaap * 100, 6) AS gaap_compliance, round(ifrs * 100, 6) AS ifrs_compliance,
           round((credit_risk + operational_risk + market_risk + (1 - mean_rate) + fraud_risk) / 5, 6) AS overall_risk_score FROM lt JOIN fr USING (supplier_id) JOIN rd USING (supplier_id)""",
    ["statements", "ledger"],
)
def r18(spark, d):
    scored = ra.market_risk(ra.operational_risk(ra.credit_risk(company(spark, d))))
    latest = ra.latest_per(scored, ["supplier_id"], "fiscal_year", "credit_risk_score", "operational_risk_score", "market_risk_score")
    latest = latest.select("supplier_id", *[F.col(f"{c}_risk_score").alias(f"{c}_risk") for c in ("credit", "operational", "market")])
    rows = v.ledger(spark, d, *[c for c in RULE_COLUMNS if c != "session_id"], "supplier_id", "amount")
    rates = co.framework_rates(rows, ["supplier_id"], amount="gross")
    names = (("sox_score", "SOX"), ("gaap_compliance", "GAAP"), ("ifrs_compliance", "IFRS"))
    by_framework = rates.groupBy("supplier_id").agg(
        (1 - F.avg("compliance_rate")).alias("compliance_risk"),
        *[F.max(F.when(F.col("regulation") == f, F.col("compliance_rate") * 100)).alias(n) for n, f in names],
    )
    fraud = rows.groupBy("supplier_id").agg((F.count_if(F.col("amount") % 100 == 0) / F.count(F.lit(1))).alias("fraud_risk"))
    out = rk.scorecards([latest, by_framework, fraud], "supplier_id")
    parts = ("credit_risk", "operational_risk", "market_risk", "compliance_risk", "fraud_risk")
    total = F.lit(0.0)
    for p in parts:
        total = total + F.col(p)
    return rounded(out.withColumn("overall_risk_score", total / 5))


@query(
    "r18_session_scores",
    f"""WITH {PORT_SQL}, {CONTROLS_SQL}, cs2 AS (SELECT company AS session_id, greatest(100 - 20 * ((NOT ceo_certification)::INT + (NOT cfo_certification)::INT + (NOT icfr_assessment)::INT + (disclosure_days > 4)::INT), 0) AS sox_score FROM ctl),
    vr AS (SELECT account_id AS session_id, round(count(*) FILTER (k < 10) / CAST(count(*) AS DOUBLE), 6) AS fraud_risk FROM activity GROUP BY 1)
    SELECT session_id, round(portfolio_risk_score, 9) AS overall_risk_score, CAST(sox_score AS INTEGER) AS sox_score, fraud_risk FROM pf JOIN cs2 USING (session_id) JOIN vr USING (session_id)""",
    ["findings", "anomalies", "activity"],
)
def r18_sessions(spark, d):
    p = rk.portfolio(*_fa(spark, d), ["session_id"]).select("session_id", r("portfolio_risk_score", 9).alias("overall_risk_score"))
    c = co.company_controls(controls(spark, d)).select(F.col("company").alias("session_id"), F.col("compliance_score").alias("sox_score"))
    a = v.activity(spark, d).groupBy(F.col("account_id").alias("session_id")).agg(r(F.count_if(F.col("k") < 10) / F.count(F.lit(1))).alias("fraud_risk"))
    return p.join(c, "session_id").join(a, "session_id")
