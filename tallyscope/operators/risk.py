"""Risk scores, routing, findings and advice at session or finding grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.constants import (
    ADVICE_RULES,
    ANOMALY_SEVERITY_SCORE,
    FINDING_SEVERITY_SCORE,
    LEVEL_ACTIONS,
    METHOD_CONFIDENCE,
    METHOD_STEPS,
    METHOD_WEIGHTS,
    NEXT_STEPS,
    OVERALL_RISK_WEIGHTS,
    PRIORITY_RANK,
    RECOMMENDATIONS,
    SEVERITY_RANK,
)
from tallyscope.functions.scores import clamp, mapped, risk_level, title_case
from tallyscope.operators.ordered import scan, top_n

SEVERE = ("high", "critical")
SCORE, WEIGHT = "decimal(18,9)", "decimal(9,4)"


def method_dimension(spark: SparkSession) -> DataFrame:
    """Weight and confidence by method; the weights differ from ``config.BASE["weights"]``, which tunes the combined score."""
    rows = [(m, w, METHOD_CONFIDENCE[m]) for m, w in METHOD_WEIGHTS.items()]
    return spark.createDataFrame(rows, "method string, weight double, method_confidence double")


def method_risk(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted session score over (keys, method, score [, confidence]) rows.

    Weights are not normalised, so the sum can pass 1 before the clamp. The sum is one of
    decimals, so that it meets the bounds of a level the same way for every order of rows.
    """
    dim = F.broadcast(method_dimension(scores.sparkSession))
    rows = scores.join(dim, "method")
    confidence = F.coalesce("confidence", "method_confidence") if "confidence" in scores.columns else F.col("method_confidence")
    out = rows.groupBy(*keys).agg(
        clamp(F.sum(F.col("score").cast(SCORE) * F.col("weight").cast(WEIGHT)).cast("double")).alias("overall_risk_score"),
        F.avg(confidence).alias("confidence_score"),
        F.count(F.lit(1)).alias("methods_used"),
    )
    return out.withColumn("risk_level", risk_level(F.col("overall_risk_score"), "engine"))


def composite(rows: DataFrame, keys: Sequence[str], score: str, weight: str) -> DataFrame:
    """Weighted score over decimals; weights are normalised when their sum is off 1 by more than 0.01."""
    w = F.col(weight).cast(WEIGHT)
    out = rows.groupBy(*keys).agg(F.sum(F.col(score).cast(SCORE) * w).cast("double").alias("_s"), F.sum(w).cast("double").alias("_w"))
    value = F.when(F.abs(F.col("_w") - 1) > 0.01, F.col("_s") / F.col("_w")).otherwise(F.col("_s"))
    return out.withColumn("composite_score", clamp(value)).drop("_s", "_w")


def overall_risk(p_value: Column, violations: Column, anomalies: Column, transactions: Column, extra: dict[str, Column] | None = None) -> Column:
    """Overall score from p-value, violation rate, anomaly rate and volume."""
    w = OVERALL_RISK_WEIGHTS
    statistical = F.when(p_value <= 0, 1.0).when(p_value >= 1, 0.0).otherwise(1 - F.exp(-5 * (1 - p_value)))
    v_rate = F.try_divide(violations.cast("double"), transactions)
    regulatory = F.when(transactions <= 0, 0.0).when(v_rate >= 0.1, 1.0).otherwise(F.least(v_rate * 10, F.lit(1.0)))
    a_rate = F.try_divide(anomalies.cast("double"), transactions)
    anomaly = (
        F.when(transactions <= 0, 0.0)
        .when(a_rate <= 0.02, a_rate / 0.02 * 0.3)
        .otherwise(0.3 + F.least(F.lit(0.7), (a_rate - 0.02) * 20))
    )
    volume = F.when(transactions < 10, 0.7).when(transactions < 100, 0.3).when(transactions > 10_000, 0.4).otherwise(0.1)
    score = (
        statistical * w["statistical_deviation"]
        + regulatory * w["regulatory_violations"]
        + anomaly * w["anomaly_detection"]
        + volume * w["volume_analysis"]
    )
    for name, value in (extra or {}).items():
        score = score + value * w.get(name, 0.05)
    return clamp(score)


def finding_risk(severity: str = "severity", confidence: str = "confidence", impact: str = "financial_impact", reference: str = "regulatory_reference") -> Column:
    base = mapped(F.lower(severity), FINDING_SEVERITY_SCORE, 0.3)
    money = F.coalesce(F.col(impact).cast("double"), F.lit(0.0))
    size = F.when(money != 0, F.least(F.lit(0.3), F.log10(F.greatest(money, F.lit(1.0))) / 10)).otherwise(0.0)
    ref = F.when(F.coalesce(F.col(reference), F.lit("")) != "", 0.1).otherwise(0.0)
    return clamp((base + size + ref) * (0.5 + F.coalesce(F.col(confidence), F.lit(0.5)) * 0.5))


def anomaly_risk(confidence: str = "confidence", severity: str = "severity") -> Column:
    return F.coalesce(F.col(confidence), F.lit(0.5)) * mapped(
        F.coalesce(F.col(severity), F.lit("low")), ANOMALY_SEVERITY_SCORE, 0.3
    )


def item_risks(findings: DataFrame, anomalies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finding and anomaly risk scores in one long table (keys, source, risk)."""
    return findings.select(*keys, F.lit("finding").alias("source"), finding_risk().alias("risk")).unionByName(
        anomalies.select(*keys, F.lit("anomaly").alias("source"), anomaly_risk().alias("risk"))
    )


def concentration(findings: DataFrame, keys: Sequence[str], category: str = "category") -> DataFrame:
    """Sum over categories of max(0, share - 0.5) * 0.4, at most 0.2."""
    keys = list(keys)
    counts = findings.groupBy(*keys, F.coalesce(F.col(category), F.lit("unknown")).alias("_cat")).count()
    # only one category can hold more than half of a group's findings
    out = counts.groupBy(*keys).agg((F.max("count") / F.sum("count")).alias("_share"))
    value = F.least(F.greatest(F.col("_share") - 0.5, F.lit(0.0)) * 0.4, F.lit(0.2))
    return out.select(*keys, value.alias("concentration_risk"))


def portfolio(findings: DataFrame, anomalies: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    risks = item_risks(findings, anomalies, keys)
    is_f, is_a = F.col("source") == "finding", F.col("source") == "anomaly"
    zero = F.lit(0.0)
    out = risks.groupBy(*keys).agg(
        F.count_if(is_f).alias("finding_count"),
        F.count_if(is_a).alias("anomaly_count"),
        F.coalesce(F.max(F.when(is_f, F.col("risk"))), zero).alias("max_finding_risk"),
        F.coalesce(F.avg(F.when(is_f, F.col("risk"))), zero).alias("avg_finding_risk"),
        F.coalesce(F.max(F.when(is_a, F.col("risk"))), zero).alias("max_anomaly_risk"),
        F.coalesce(F.avg(F.when(is_a, F.col("risk"))), zero).alias("avg_anomaly_risk"),
    )
    out = out.join(concentration(findings, keys), keys, "left").withColumn(
        "concentration_risk", F.coalesce("concentration_risk", zero)
    )
    base = (
        F.col("max_finding_risk") * 0.4
        + F.col("avg_finding_risk") * 0.2
        + F.col("max_anomaly_risk") * 0.3
        + F.col("avg_anomaly_risk") * 0.1
    )
    out = out.withColumn("portfolio_risk_score", F.least(F.lit(1.0), base + F.col("concentration_risk")))
    return out.withColumn("risk_level", risk_level(F.col("portfolio_risk_score"), "calculator"))


def level_histogram(risks: DataFrame, keys: Sequence[str], score: str = "risk", scale: str = "calculator") -> DataFrame:
    """Rows per risk level, with zero for empty levels."""
    level = risk_level(F.col(score), scale)
    names = ("low", "medium", "high", "critical")
    counts = risks.groupBy(*keys).agg(*[F.count_if(level == n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("n")) for n in names])
    return counts.select(*keys, F.inline(pairs))


def severity_rank(col: str = "severity") -> Column:
    return mapped(F.lower(F.coalesce(F.col(col), F.lit("unknown"))), SEVERITY_RANK, 0)


def finding_totals(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(F.col("severity").isin(*SEVERE)).alias("critical_count"),
        F.count_if(F.col("severity") == "medium").alias("medium_count"),
    )


def top_findings(findings: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    return top_n(findings, keys, [severity_rank().desc(), F.col("finding_id")], n)


def top_anomalies(anomalies: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    return top_n(anomalies, keys, [F.col("confidence").desc(), F.col("anomaly_id")], n)


def anomaly_totals(anomalies: DataFrame, keys: Sequence[str]) -> DataFrame:
    return anomalies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.count_if(F.col("confidence") > 0.8).alias("high_confidence_count"),
        F.count_if(F.col("type") == "statistical_deviation").alias("statistical_anomalies"),
        F.count_if(F.col("type") == "rl_anomaly").alias("rl_detected_anomalies"),
        F.avg("confidence").alias("avg_confidence"),
    )


def session_signals(portfolios: DataFrame, findings: DataFrame, anomalies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Risk score, severe findings and confident anomalies per session."""
    keys = list(keys)
    severe = findings.groupBy(*keys).agg(F.count_if(F.col("severity").isin(*SEVERE)).alias("severe_findings"))
    sure = anomalies.groupBy(*keys).agg(F.count_if(F.col("confidence") > 0.8).alias("confident_anomalies"))
    out = portfolios.join(severe, keys, "left").join(sure, keys, "left")
    return out.na.fill(0, subset=["severe_findings", "confident_anomalies"])


def route(score: Column, severe: Column, sure: Column) -> Column:
    return (
        F.when((score >= 0.8) | (severe >= 3) | (sure >= 5), "deep_dive")
        .when((score >= 0.5) | (severe >= 1) | (sure >= 2), "human_review")
        .otherwise("generate_report")
    )


def urgency(score: Column, severe: Column, sure: Column) -> Column:
    return (
        F.when((score > 0.8) | (severe >= 3), "urgent")
        .when((score > 0.5) | (severe >= 1) | (sure >= 2), "high")
        .when((score > 0.3) | (sure >= 1), "medium")
        .otherwise("low")
    )


def compliance_status(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    worst = findings.groupBy(*keys).agg(F.max(severity_rank()).alias("_worst"))
    label = (
        F.when(F.col("_worst") == 4, "NON_COMPLIANT").when(F.col("_worst") == 3, "CONDITIONALLY_COMPLIANT").otherwise("COMPLIANT")
    )
    return worst.select(*keys, label.alias("compliance_status"))


def generated_findings(session_risk: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """One finding per session, and one per method that scores above 0.7."""
    main = session_risk.select(
        F.col(key).alias("audit_session_id"),
        F.lit("Statistical Analysis").alias("category"),
        F.col("risk_level").alias("severity"),
        F.lit("Comprehensive Statistical Anomaly Analysis").alias("title"),
        F.lit("SOX Section 404, PCAOB AS 2201").alias("regulatory_reference"),
        F.col("confidence_score"),
    )
    name = title_case(F.col("method"))
    by_method = scores.where(F.col("score") > 0.7).select(
        F.col(key).alias("audit_session_id"),
        F.concat(F.lit("Statistical Analysis - "), name).alias("category"),
        F.when(F.col("score") > 0.8, "high").otherwise("medium").alias("severity"),
        F.concat(F.lit("High Risk Detected by "), name).alias("title"),
        F.lit("PCAOB AS 2301 - Audit Evidence").alias("regulatory_reference"),
        F.col("score").alias("confidence_score"),
    )
    return main.unionByName(by_method)


def advice_rules(spark: SparkSession, rule_set: str) -> DataFrame:
    rows = [r[1:] for r in ADVICE_RULES if r[0] == rule_set]
    return spark.createDataFrame(rows, "seq int, metric string, comparison string, bound double, text string")


def advise(metrics: DataFrame, keys: Sequence[str], rule_set: str, limit: int | None = None) -> DataFrame:
    """Texts of the rules that fire on long (keys, metric, value) rows, in rule order."""
    rules = F.broadcast(advice_rules(metrics.sparkSession, rule_set))
    fires = F.when(F.col("comparison") == ">", F.col("value") > F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    hits = metrics.join(rules, "metric").where(fires)
    # at most one entry per rule, so the list is as short as the rule table
    ordered = F.sort_array(F.collect_set(F.struct("seq", "text")))
    ordered = F.slice(ordered, 1, limit) if limit else ordered
    return hits.groupBy(*keys).agg(F.transform(ordered, lambda s: s["text"]).alias("texts"))


def next_steps(session_risk: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Sorted distinct next steps from the risk level and the methods above 0.7."""
    high = scores.where(F.col("score") > 0.7).groupBy(key).agg(F.collect_set("method").alias("_m"))  # six methods at most
    rows = session_risk.join(high, key, "left")
    level = None
    for name, steps in NEXT_STEPS.items():
        arr = F.array(*[F.lit(s) for s in steps])
        cond = F.col("risk_level") == name
        level = F.when(cond, arr) if level is None else level.when(cond, arr)
    extra = F.filter(
        F.array(
            *[
                F.when(F.arrays_overlap(F.coalesce("_m", F.array().cast("array<string>")), F.array(*[F.lit(m) for m in ms])), F.lit(step))
                for ms, step in METHOD_STEPS
            ]
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select(key, F.explode(F.array_sort(F.array_distinct(F.concat(level, extra)))).alias("step"))


def comprehensive_advice(session_risk: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Level and score lines, the methods above 0.7 in name order, and the actions of the level."""
    high = scores.where(F.col("score") > 0.7).groupBy(key).agg(F.array_sort(F.collect_set("method")).alias("_m"))  # six methods at most
    actions = None
    for name, texts in LEVEL_ACTIONS.items():
        arr = F.array(*[F.lit(t) for t in texts])
        cond = F.col("risk_level") == name
        actions = F.when(cond, arr) if actions is None else actions.when(cond, arr)
    head = F.array(
        F.concat(F.lit("Overall risk level: "), F.upper("risk_level")),
        F.concat(F.lit("Comprehensive risk score: "), F.format_string("%.2f", "overall_risk_score")),
    )
    by = F.when(F.col("_m").isNotNull(), F.array(F.concat(F.lit("High risk detected by: "), F.array_join("_m", ", ")))).otherwise(
        F.array().cast("array<string>")
    )
    return session_risk.join(high, key, "left").select(key, F.concat(head, by, actions).alias("recommendations"))


def recommendations(session_risk: DataFrame, scores: DataFrame, success: DataFrame, key: str) -> DataFrame:
    """Recommendations per session by trigger: severe level, method above 0.7, low success, always.

    Triggers are turned into rows first and meet the small recommendation table by name.
    """
    dim = session_risk.sparkSession.createDataFrame(
        RECOMMENDATIONS, "trigger string, priority string, category string, title string, timeline string"
    )
    fired = (
        session_risk.where(F.col("risk_level").isin("critical", "high")).select(key, F.lit("severe_level").alias("trigger"))
        .unionByName(scores.where(F.col("score") > 0.7).select(key, F.col("method").alias("trigger")))
        .unionByName(success.where(F.col("success_rate") < 0.8).select(key, F.lit("low_success").alias("trigger")))
        .unionByName(session_risk.select(key, F.lit("always").alias("trigger")))
    )
    return prioritized(fired.join(F.broadcast(dim), "trigger"), [key], tie="trigger")


def scorecards(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """One row per key with the scores of every part that has it."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, "left")
    return out


def prioritized(recommendations: DataFrame, keys: Sequence[str], priority: str = "priority", tie: str = "title") -> DataFrame:
    """Recommendations with their rank: CRITICAL, HIGH, MEDIUM, LOW, then title."""
    return scan(recommendations, keys, [mapped(F.col(priority), PRIORITY_RANK, 4), F.col(tie)], number="rank")


def high_severity_recommendations(findings: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    severe = findings.where(F.col("severity").isin(*SEVERE))
    return top_n(severe, keys, [F.col("finding_id")], n).select(*keys, "rank", "recommendation")
