"""Known values of ratios, company risk, controls, portfolio and risk scales."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyscope import config
from tallyscope.functions.scores import clipped, risk_level
from tallyscope.operators import compliance, ratios, risk, stats
from tallyscope.operators.outliers import amount_sanity

STATEMENT = Row(
    company="c", total_assets=1_000_000.0, total_liabilities=400_000.0, total_equity=400_000.0, revenue=500_000.0, net_income=50_000.0,
    current_assets=300_000.0, current_liabilities=150_000.0, cash=100_000.0, inventory=50_000.0, ebit=75_000.0, interest_expense=15_000.0,
    gross_profit=200_000.0, expenses=450_000.0,
)


def test_ratios(spark):
    df = spark.createDataFrame([STATEMENT])
    r = {x["ratio"]: x["value"] for x in ratios.long_ratios(df, ["company"]).collect()}
    assert r["current_ratio"] == 2.0 and r["cash_ratio"] == pytest.approx(2 / 3) and r["net_profit_margin"] == pytest.approx(0.1)
    assert r["return_on_assets"] == pytest.approx(0.05) and r["return_on_equity"] == pytest.approx(0.125)
    assert r["interest_coverage"] == 5.0 and r["quick_ratio"] == pytest.approx(250 / 150)


def test_missing_input_has_no_ratio(spark):
    df = spark.createDataFrame([Row(company="c", current_assets=1.0, current_liabilities=0.0)])
    assert ratios.long_ratios(df, ["company"]).count() == 0


def test_benchmark_flags(spark):
    values = spark.createDataFrame([("c", "current_ratio", 0.5), ("c", "debt_to_equity", 3.0), ("c", "net_profit_margin", 0.1)], "company string, ratio string, value double")
    bench = spark.createDataFrame([("current_ratio", 1.0, 2.0, 3.0), ("debt_to_equity", 0.2, 1.0, 2.0), ("net_profit_margin", 0.05, 0.1, 0.2)], "ratio string, min double, median double, max double")
    got = {(r["ratio"], r["flag"]) for r in ratios.benchmark_flags(values, bench, ["company"]).collect()}
    assert got == {("current_ratio", "below_minimum"), ("current_ratio", "far_from_median"), ("debt_to_equity", "above_maximum"), ("debt_to_equity", "far_from_median")}


def test_company_risk(spark):
    df = spark.createDataFrame([Row(customer_concentration=0.4, geographic_concentration=0.6, key_personnel_risk=True, regulatory_changes=False,
                                    variable_rate_debt_pct=0.6, foreign_revenue_pct=0.4, commodity_exposure=True, beta=1.6)])
    r = ratios.market_risk(ratios.operational_risk(df)).first()
    assert r["operational_risk_score"] == pytest.approx(0.9) and r["operational_risk_level"] == "Critical"
    assert r["market_risk_score"] == pytest.approx(1.0) and len(r["market_risk_factors"]) == 4


def test_value_at_risk_order(spark):
    xs = [-0.02, 0.01, 0.03, -0.05, 0.02, -0.01, 0.04, -0.03, 0.01, 0.0]
    df = spark.createDataFrame([("s", x) for x in xs], "k string, r double")
    a = stats.value_at_risk(df, ["k"], "r", 0.95).first()["value_at_risk"]
    b = stats.value_at_risk(df, ["k"], "r", 0.99).first()["value_at_risk"]
    assert b <= a < 0


def test_controls(spark):
    schema = "ceo_certification boolean, cfo_certification boolean, icfr_assessment boolean, disclosure_days int"
    rows = compliance.company_controls(spark.createDataFrame([(True, True, True, 2), (False, None, False, 6)], schema)).collect()
    assert [(r["compliance_score"], len(r["violations"])) for r in rows] == [(100, 0), (20, 4)]


def test_disclosures(spark):
    full = {c: "x" * 200 for c in compliance.DISCLOSURE_ITEMS}
    part = {c: None for c in compliance.DISCLOSURE_ITEMS} | {"accounting_policies": "short"}
    schema = ", ".join(f"{c} string" for c in compliance.DISCLOSURE_ITEMS)
    df = spark.createDataFrame([tuple(full.values()), tuple(part[c] for c in compliance.DISCLOSURE_ITEMS)], schema)
    a, b = compliance.disclosures(df).collect()
    assert (a["completeness_score"], a["insufficient_policies"]) == (100, False)
    assert (b["completeness_score"], b["insufficient_policies"]) == (40, True)
    assert "Missing disclosure: Segment Information" in b["missing_disclosures"]


def test_checks_cover_warnings_and_passes(spark):
    schema = ("id int, amount double, kind string, management_approved boolean, authorized_by string, transaction_date date, service_date date, "
              "contract_id string, related_revenue_id string, category string, classification string")
    import datetime as dt

    rows = [
        (1, 2e6, "revenue", None, "", dt.date(2024, 1, 1), dt.date(2024, 2, 1), None, None, "other", None),
        (2, 50.0, "revenue", True, "a", dt.date(2024, 1, 1), None, "c", None, "financial_asset", None),
        (3, 20_000.0, "expense", True, "a", None, None, None, "", "other", None),
        (4, 10.0, "other", True, "a", None, None, None, None, "other", None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r["id"], r["rule"], r["kind"]) for r in compliance.issues(df, ["id"]).collect()}
    assert got == {
        (1, "SOX Section 302", "violation"), (1, "SOX Section 404", "violation"), (1, "GAAP Revenue Recognition", "violation"), (1, "IFRS 15", "violation"),
        (2, "GAAP Revenue Recognition", "warning"), (2, "IFRS 9", "violation"), (3, "GAAP Matching Principle", "warning"),
    }
    rates = {r["regulation"]: r for r in compliance.framework_rates(df, []).collect()}
    assert rates["SOX"]["checks_performed"] == 8 and rates["SOX"]["passed_checks"] == 6
    assert rates["GAAP"]["passed_checks"] == 1 and rates["GAAP"]["warnings"] == 2 and rates["IFRS"]["compliance_rate"] == pytest.approx(1 / 3)
    none = {r["regulation"]: r["compliance_rate"] for r in compliance.framework_rates(df.where("id = 4"), []).collect()}
    assert none["GAAP"] == 1.0 and none["IFRS"] == 1.0


def test_finding_risk(spark):
    schema = "severity string, confidence double, financial_impact double, regulatory_reference string"
    df = spark.createDataFrame([("critical", 1.0, 1e6, "SOX"), ("low", 0.0, None, None), ("odd", None, 0.0, "")], schema)
    assert [r[0] for r in df.select(risk.finding_risk()).collect()] == pytest.approx([1.0, 0.15, 0.225])


def test_levels_and_modes(spark):
    df = spark.createDataFrame([(0.6,), (0.8,), (0.9,), (0.1,)], "s double")
    assert [r[0] for r in df.select(risk_level(F.col("s"))).collect()] == ["medium", "high", "critical", "low"]
    assert config.contamination("aggressive", "standard") == 0.15 and config.contamination("standard", "unknown") == 0.10
    assert config.preset("compliance_review")["quality"]["maximum_missing"] == 5.0
    assert config.for_mode("conservative")["risk"]["critical"] == 0.85 and config.for_mode()["risk"]["critical"] == 0.9


def test_amount_sanity(spark):
    df = spark.createDataFrame([(0.01,), (5000.0,), (11_000_000.0,), (37.5,)], "a double")
    parts = amount_sanity(F.col("a"))
    rows = df.select(parts["flags"].alias("f"), parts["risk_score"].alias("r")).collect()
    assert [len(r["f"]) for r in rows] == [1, 1, 2, 0] and rows[2]["r"] == pytest.approx(0.6)


def test_clipping(spark):
    df = spark.createDataFrame([("a" * 510,), ("short",)], "t string")
    rows = df.select(clipped(F.col("t"), 500)).collect()
    assert len(rows[0][0]) == 503 and rows[1][0] == "short"
