"""Financial ratios, ratio warnings, company risk and stress scenarios over statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.constants import STRESS_SCENARIOS
from tallyscope.functions.scores import flags, ratio, risk_level

RATIOS = {
    "current_ratio": ("current_assets", "current_liabilities"),
    "cash_ratio": ("cash", "current_liabilities"),
    "gross_profit_margin": ("gross_profit", "revenue"),
    "net_profit_margin": ("net_income", "revenue"),
    "return_on_assets": ("net_income", "total_assets"),
    "return_on_equity": ("net_income", "total_equity"),
    "debt_to_equity": ("total_liabilities", "total_equity"),
    "debt_to_assets": ("total_liabilities", "total_assets"),
    "interest_coverage": ("ebit", "interest_expense"),
    "equity_ratio": ("total_equity", "total_assets"),
    "expense_ratio": ("expenses", "revenue"),
    "asset_turnover": ("revenue", "total_assets"),
}


def with_ratios(statements: DataFrame) -> DataFrame:
    """Add every ratio whose inputs the table has; missing or zero divisor gives null."""
    out = statements
    if {"current_assets", "inventory", "current_liabilities"} <= set(statements.columns):
        out = out.withColumn("quick_ratio", ratio(F.col("current_assets") - F.col("inventory"), F.col("current_liabilities")))
    for name, (a, b) in RATIOS.items():
        if a in statements.columns and b in statements.columns:
            out = out.withColumn(name, ratio(F.col(a), F.col(b)))
    return out


def long_ratios(statements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ratio, value): absent ratios have no row."""
    wide = with_ratios(statements)
    names = [n for n in ["quick_ratio", *RATIOS] if n in wide.columns]
    return wide.unpivot(list(keys), names, "ratio", "value").where(F.col("value").isNotNull())


def benchmark_flags(ratios: DataFrame, benchmarks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per flag: below minimum, above maximum, more than 50 % from the median."""
    rows = ratios.join(benchmarks, "ratio")
    hit = flags(
        (F.col("value") < F.col("min"), "below_minimum"),
        (F.col("value") > F.col("max"), "above_maximum"),
        (F.abs(F.col("value") - F.col("median")) / F.col("median") > 0.5, "far_from_median"),
    )
    return rows.select(*keys, "ratio", "value", F.explode(hit).alias("flag"))


def ratio_warnings(statements: DataFrame) -> DataFrame:
    """Debt over 0.8 of assets and current ratio under 1; a missing current ratio counts as 0."""
    wide = with_ratios(statements)
    hit = flags(
        (F.coalesce("debt_to_assets", F.lit(0.0)) > 0.8, "high_debt_to_assets"),
        (F.coalesce("current_ratio", F.lit(0.0)) < 1.0, "low_current_ratio"),
    )
    return wide.withColumn("warnings", hit).withColumn("risk_score", F.least(F.size("warnings") * 0.3, F.lit(1.0)))


def _scored(df: DataFrame, prefix: str, rules) -> DataFrame:
    """Additive points: ``rules`` are (condition, points, factor)."""
    points = sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0.0) for c, p, _ in rules), F.lit(0.0))
    raw = F.round(points, 10)  # sums of tenths
    return (
        df.withColumn(f"{prefix}_risk_score", F.least(raw, F.lit(1.0)))
        .withColumn(f"{prefix}_risk_level", F.initcap(risk_level(raw, "assessment")))
        .withColumn(f"{prefix}_risk_factors", flags(*[(F.coalesce(c, F.lit(False)), f) for c, _, f in rules]))
    )


def credit_risk(statements: DataFrame) -> DataFrame:
    wide = with_ratios(statements)
    return _scored(
        wide,
        "credit",
        [
            (F.col("debt_to_equity") > 2.0, 0.3, "debt_to_equity"),
            ((F.col("interest_expense") > 0) & (F.col("interest_coverage") < 2.5), 0.4, "interest_coverage"),
            (F.col("current_ratio") < 1.0, 0.3, "liquidity"),
        ],
    )


def operational_risk(df: DataFrame) -> DataFrame:
    return _scored(
        df,
        "operational",
        [
            (F.col("customer_concentration") > 0.3, 0.4, "customer_concentration"),
            (F.col("geographic_concentration") > 0.5, 0.2, "geographic_concentration"),
            (F.col("key_personnel_risk"), 0.3, "key_personnel"),
            (F.col("regulatory_changes"), 0.2, "regulatory_changes"),
        ],
    )


def market_risk(df: DataFrame) -> DataFrame:
    return _scored(
        df,
        "market",
        [
            (F.col("variable_rate_debt_pct") > 0.5, 0.3, "interest_rate"),
            (F.col("foreign_revenue_pct") > 0.3, 0.2, "foreign_exchange"),
            (F.col("commodity_exposure"), 0.2, "commodity"),
            (F.col("beta") > 1.5, 0.3, "volatility"),
        ],
    )


def scenario_dimension(spark: SparkSession) -> DataFrame:
    fields = sorted({k for _, shocks in STRESS_SCENARIOS for k in shocks})
    rows = [(name, *[shocks.get(f) for f in fields]) for name, shocks in STRESS_SCENARIOS]
    return spark.createDataFrame(rows, "scenario string, " + ", ".join(f"{f} double" for f in fields))


def stress(statements: DataFrame) -> DataFrame:
    """Shocked revenue, expenses and assets of every statement under every scenario."""
    rows = statements.crossJoin(F.broadcast(scenario_dimension(statements.sparkSession)))

    def shock(c):
        return 1 + F.coalesce(c, F.lit(0.0))

    return (
        rows.withColumn("stressed_revenue", F.col("revenue") * shock("revenue_change"))
        .withColumn(
            "stressed_expenses",
            F.col("expenses") * shock("cost_increase")
            + F.col("total_liabilities")
            * (F.coalesce("interest_rate_increase", F.lit(0.0)) + F.coalesce("debt_refinancing_cost", F.lit(0.0))),
        )
        .withColumn("stressed_assets", F.col("total_assets") * shock("asset_value_decline"))
        .withColumn("stressed_net_income", F.col("stressed_revenue") - F.col("stressed_expenses"))
    )


def latest_per(df: DataFrame, keys: Sequence[str], order: str, *columns: str) -> DataFrame:
    """Most recent statement per key: the columns of the row with the largest ``order``."""
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(order, *columns), order).alias("_s"))
    return newest.select(*keys, "_s.*")


def period_rollup(ledger: DataFrame, keys: Sequence[str], date: str, amount: str, kind: str) -> DataFrame:
    """Revenue, expenses, net income and margin per quarter, with the change to the last quarter."""
    from pyspark.sql import Window

    keys = list(keys)
    out = ledger.groupBy(*keys, F.trunc(date, "quarter").alias("quarter")).agg(
        F.coalesce(F.sum(F.when(F.col(kind) == "revenue", F.col(amount))), F.lit(0)).cast("double").alias("revenue"),
        F.coalesce(F.sum(F.when(F.col(kind) == "expense", F.col(amount))), F.lit(0)).cast("double").alias("expenses"),
    )
    out = out.withColumn("net_income", F.col("revenue") - F.col("expenses")).withColumn(
        "net_margin", ratio(F.col("net_income"), F.col("revenue"))
    )
    before = F.lag("revenue").over(Window.partitionBy(*keys).orderBy("quarter"))  # one row per quarter
    return out.withColumn("revenue_change", ratio(F.col("revenue") - before, before))
