"""Regulatory rules over transactions and their roll-ups.

All rules run in one pass: each row yields an array of the checks that apply to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.constants import (
    COMPLIANCE_ADVICE,
    COMPLIANCE_ALL_CLEAR,
    COMPLIANCE_MORE_WARNINGS,
    DISCLOSURE_ITEMS,
    RULE_CATALOGUE,
)
from tallyscope.functions.scores import flags, title_case

FRAMEWORKS = ("SOX", "GAAP", "IFRS")


def _absent(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def rules(amount: str = "amount", date: str = "transaction_date", materiality: float = 1_000_000, expense_limit: float = 10_000):
    """The checks as (rule, regulation, applies, outcome, severity, description).

    ``outcome`` is 'violation', 'warning', 'warning_pass' or 'pass'.
    """
    x = F.col(amount)
    revenue, expense = F.col("kind") == "revenue", F.col("kind") == "expense"
    early = F.col(date) < F.col("service_date")
    dated = F.col(date).isNotNull() & F.col("service_date").isNotNull()
    unmatched = _absent("related_revenue_id") & (x > expense_limit)

    def fails(condition):
        return F.when(condition, "violation").otherwise("pass")

    return [
        ("SOX Section 302", "SOX", F.lit(True), fails((x > materiality) & ~F.coalesce("management_approved", F.lit(False))),
         "high", F.lit("High-value transaction without management certification")),
        ("SOX Section 404", "SOX", F.lit(True), fails(_absent("authorized_by")),
         "medium", F.lit("Transaction lacks proper authorization documentation")),
        ("GAAP Revenue Recognition", "GAAP", revenue, F.when(~dated, "warning").when(early, "violation").otherwise("pass"),
         "medium", F.when(dated, "Revenue recognized before service performance").otherwise(
             "Missing date information for revenue recognition validation")),
        ("GAAP Matching Principle", "GAAP", expense, F.when(unmatched, "warning_pass").otherwise("pass"),
         None, F.lit("Large expense without clear revenue matching")),
        ("IFRS 15", "IFRS", revenue, fails(_absent("contract_id")),
         "medium", F.lit("Revenue transaction without contract identification")),
        ("IFRS 9", "IFRS", F.col("category").isin("financial_asset", "financial_liability"), fails(_absent("classification")),
         "medium", F.lit("Financial instrument without proper classification")),
    ]


def checks(only_issues: bool = False, **options):
    """Array column of the checks that apply to a transaction, or only those with an issue."""

    def entry(rule, regulation, applies, outcome, severity, text):
        body = F.struct(
            F.lit(rule).alias("rule"), F.lit(regulation).alias("regulation"), outcome.alias("outcome"),
            F.lit(severity).alias("severity"), text.alias("description"),
        )
        return F.when(F.coalesce(applies, F.lit(False)) & ((outcome != "pass") if only_issues else F.lit(True)), body)

    return F.filter(F.array(*[entry(*r) for r in rules(**options)]), lambda c: c.isNotNull())


def results(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """Every check performed: keys, rule, regulation, outcome, severity, description."""
    return df.select(*keys, F.explode(checks(**options)).alias("c")).select(*keys, "c.*")


def issues(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """Violations and warnings only, with ``kind``; passing checks never leave the row."""
    out = df.select(*keys, F.explode(checks(only_issues=True, **options)).alias("c")).select(*keys, "c.*")
    kind = F.when(F.col("outcome") == "violation", "violation").otherwise("warning")
    return out.withColumn("kind", kind).withColumn("severity", F.when(kind == "violation", F.col("severity"))).drop("outcome")


def framework_rates(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """Checks, passes, violations, warnings and rate per group and framework (1.0 without checks).

    Counted by conditions in one combined pass; no check becomes a row.
    """
    outcomes = {
        "checks_performed": None, "passed_checks": ("pass", "warning_pass"), "violations": ("violation",),
        "warnings": ("warning", "warning_pass"),
    }
    sums, frames = [], []
    for f in FRAMEWORKS:
        mine = [(F.coalesce(applies, F.lit(False)), outcome) for _, reg, applies, outcome, _, _ in rules(**options) if reg == f]
        for name, wanted in outcomes.items():
            hits = [F.count_if(a if wanted is None else a & o.isin(*wanted)) for a, o in mine]
            sums.append(sum(hits[1:], hits[0]).alias(f"{f}_{name}"))
        frames.append(F.struct(F.lit(f).alias("regulation"), *[F.col(f"{f}_{n}").alias(n) for n in outcomes]))
    out = df.groupBy(*keys).agg(*sums).select(*keys, F.inline(F.array(*frames)))
    rate = F.coalesce(F.try_divide(F.col("passed_checks").cast("double"), F.col("checks_performed")), F.lit(1.0))
    return out.withColumn("compliance_rate", rate)


def overall(rates: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Overall rate, level and violation rate; ``totals`` gives ``total_transactions`` per group."""
    out = rates.groupBy(*keys).agg(
        F.avg("compliance_rate").alias("overall_compliance_rate"),
        F.sum("violations").alias("total_violations"),
        F.sum("warnings").alias("total_warnings"),
    )
    out = out.join(totals, keys) if keys else out.crossJoin(totals)
    rate, bad = F.col("overall_compliance_rate"), F.col("total_violations")
    level = (
        F.when((rate >= 0.95) & (bad == 0), "excellent")
        .when((rate >= 0.85) & (bad <= 2), "good")
        .when(rate >= 0.70, "acceptable")
        .otherwise("poor")
    )
    return out.withColumn("compliance_level", level).withColumn(
        "violation_rate", F.try_divide(bad.cast("double"), F.col("total_transactions"))
    )


def advice(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered advice texts per group: by violated framework, then warnings, else the all-clear."""
    by_group = rates.groupBy(*keys).agg(
        *[F.max(F.when(F.col("regulation") == f, F.col("violations"))).alias(f) for f in FRAMEWORKS],
        F.sum("violations").alias("_v"),
        F.sum("warnings").alias("_w"),
    )
    texts = flags(
        *[(F.col(f) > 0, text) for f, text in COMPLIANCE_ADVICE], (F.col("_w") > F.col("_v"), COMPLIANCE_MORE_WARNINGS)
    )
    texts = F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(COMPLIANCE_ALL_CLEAR)))
    return by_group.select(*keys, texts.alias("recommendations"))


def rule_catalogue(spark: SparkSession) -> DataFrame:
    """Rule dimension; entries without a check have ``implemented = false``."""
    return spark.createDataFrame(RULE_CATALOGUE, "regulation string, section string, name string, implemented boolean")


def threshold_rules(df: DataFrame, keys: list[str], rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """Data-driven rules (rule id, column, comparison, value): one row per breach, in one pass."""
    compare = {
        ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v, "=": lambda c, v: c == v,
    }
    hits = [
        F.when(
            compare[op](F.col(column).cast("double"), F.lit(float(value))),
            F.struct(F.lit(rule).alias("rule_id"), F.lit(column).alias("column"), F.col(column).cast("double").alias("value")),
        )
        for rule, column, op, value in rules
    ]
    return df.select(*keys, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select(*keys, "h.*")


def to_findings(violations: DataFrame, session: str) -> DataFrame:
    """Findings from violations, with the default title, severity and confidence."""
    return violations.select(
        F.col(session).alias("audit_session_id"),
        F.lit("regulatory_compliance").alias("category"),
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.lit("Regulatory Violation").alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.lit(0.8).alias("confidence_score"),
        F.coalesce("regulation", F.lit("")).alias("regulatory_reference"),
        F.lit("open").alias("status"),
    )


def company_controls(df: DataFrame) -> DataFrame:
    """Certification, assessment and disclosure controls; 20 points off per violation."""

    def missing(c):
        return ~F.coalesce(F.col(c), F.lit(False))

    found = flags(
        (missing("ceo_certification"), "Section 302: CEO certification"),
        (missing("cfo_certification"), "Section 302: CFO certification"),
        (missing("icfr_assessment"), "Section 404: ICFR assessment"),
        (F.coalesce("disclosure_days", F.lit(0)) > 4, "Section 409: late disclosure"),
    )
    return df.withColumn("violations", found).withColumn(
        "compliance_score", F.greatest(100 - F.size("violations") * 20, F.lit(0))
    )


def disclosures(df: DataFrame) -> DataFrame:
    """Seven required items, 10 points off per missing one, and the short-policy check."""
    missing = flags(*[(_absent(c), c) for c in DISCLOSURE_ITEMS])
    named = F.transform(missing, lambda c: F.concat(F.lit("Missing disclosure: "), title_case(c)))
    short = F.coalesce(F.length("accounting_policies") < 100, F.lit(False))
    return (
        df.withColumn("missing_disclosures", named)
        .withColumn("insufficient_policies", short)
        .withColumn("completeness_score", F.greatest(100 - F.size("missing_disclosures") * 10, F.lit(0)))
    )


def input_violations(amount: str, date: str, account: str) -> Column:
    """Array of input problems: missing fields, negative amount, amount above ten million."""
    return flags(
        (F.col(amount).isNull(), "missing_required_field:amount"),
        (F.col(date).isNull(), "missing_required_field:transaction_date"),
        (F.col(account).isNull(), "missing_required_field:account_id"),
        (F.col(amount) < 0, "invalid_amount"),
        (F.col(amount) > 10_000_000, "suspicious_amount"),
    )


def out_of_range(df: DataFrame, amount: str, low: float = 0, high: float = 1_000_000_000) -> DataFrame:
    return df.where(~F.col(amount).between(low, high))
