"""Extraction and safety on the small fixtures that the large tables do not contain."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import text as tx
from tallyscope.operators import safety

INVOICE = (
    "INVOICE #INV-12345\n\nABC Company Inc.\n123 Main Street\n\nDate: 12/15/2023\nDue Date: 01/15/2024\n\nOffice Supplies            $1,234.56\n"
    "Software License           $2,500.00\nTax                        $374.36\n\nTotal: $4,108.92\n"
)


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_invoice_fields(spark):
    assert [float(x) for x in one(spark, INVOICE, tx.amounts)] == [1234.56, 2500.0, 374.36, 4108.92]
    assert one(spark, INVOICE, tx.dates) == [dt.date(2023, 12, 15), dt.date(2024, 1, 15)]
    assert one(spark, INVOICE, tx.invoice_number) == "INV-12345"
    assert one(spark, INVOICE, tx.vendor_names) == ["ABC Company Inc"]
    assert one(spark, INVOICE, tx.currencies) == ["USD"]


def test_amount_and_date_forms(spark):
    got = [float(x) for x in one(spark, "Amount: $1,234.56\nTotal: 2,500.00 USD\nPrice: EUR 999.99\nCost: 500", tx.amounts)]
    assert got == [1234.56, 2500.0, 999.99]
    got = one(spark, "12/15/2023, 2024-01-15, Jan 15, 2024 and January 16, 2024 but not 13/45/2024", tx.dates)
    assert got == [dt.date(2023, 12, 15), dt.date(2024, 1, 15), dt.date(2024, 1, 15), dt.date(2024, 1, 16)]
    fallback = one(spark, "No invoice number here", tx.invoice_number)
    assert fallback.startswith("INV-") and len(fallback) == 12


def test_line_items(spark):
    table = "Description\tQuantity\tUnit Price\tTotal\nItem 1\t2\t$10.00\t$20.00\nItem 2\t3\t$15.00\t$45.00\nItem 3\t1\t$30.00\t$30.00\n"
    items = one(spark, table, tx.line_items)
    assert [(i["description"], i["amount"], i["line_number"]) for i in items] == [("Item 1", 20.0, 2), ("Item 2", 45.0, 3), ("Item 3", 30.0, 4)]


@pytest.mark.parametrize("name,kind", [
    ("invoice_123.pdf", "invoice"), ("inv_456.docx", "invoice"), ("bill_789.png", "invoice"), ("receipt.jpg", "invoice"),
    ("balance_sheet.pdf", "balance_sheet"), ("financial_position.docx", "balance_sheet"), ("statement.pdf", "other"),
])
def test_document_class(spark, name, kind):
    assert one(spark, name, tx.document_class) == kind


SENSITIVE = [
    (1, "SSN: 123-45-6789"), (2, "Card 4532-1234-5678-9012"), (3, "Account 12345678901"), (4, "mail john.doe@example.com now"),
    (5, "call 555-123-4567"), (6, "api_key = 'abcdefghijklmnopqrstuvwxyz123456'"), (7, "nothing here"), (8, "paid $99999 and $0.01"),
    (9, "an illegal attempt at fraud; password: hunter2hunter2"),
]


@pytest.fixture(scope="module")
def sensitive(spark):
    return spark.createDataFrame(SENSITIVE, "id int, text string")


def test_scan_positions(sensitive):
    rows = safety.scan_text(sensitive, ["id"], "text").collect()
    found = {(r["id"], r["data_type"]): SENSITIVE[r["id"] - 1][1][r["start"] : r["stop"]] for r in rows}
    assert found[(1, "ssn")] == "123-45-6789" and found[(2, "credit_card")] == "4532-1234-5678-9012"
    assert found[(3, "bank_account")] == "12345678901" and found[(4, "email")] == "john.doe@example.com"
    assert found[(5, "phone")] == "555-123-4567" and found[(6, "api_key")] == "abcdefghijklmnopqrstuvwxyz123456"
    assert not any(i == 7 for i, _ in found)


def test_scan_of_many_matches(spark):
    """A hundred thousand matches in one text, at the places that plain search finds; the work grows with their number."""
    import re
    import time

    def text(n):
        return "".join(f"{'x' * (i % 7)} 123-45-{6000 + i % 1000} é " for i in range(n))

    seconds = {}
    for n in (100, 10_000, 100_000):
        df = spark.createDataFrame([(1, text(n)), (2, ""), (3, None)], "id long, text string")
        start = time.monotonic()
        got = safety.scan_text(df, ["id"], "text").where("data_type = 'ssn'").select("start", "stop").collect()
        seconds[n] = time.monotonic() - start
        assert sorted(map(tuple, got)) == [m.span() for m in re.finditer(r"\b[0-9]{3}-?[0-9]{2}-?[0-9]{4}\b", text(n))]
    assert seconds[100_000] < 40 * max(seconds[10_000], 0.5)


def test_masking_order(sensitive):
    got = {r["id"]: r["m"] for r in sensitive.select("id", safety.masked(F.col("text")).alias("m")).collect()}
    assert got[1] == "SSN: ***MASKED***" and got[2] == "Card ***MASKED***" and got[3] == "Account ***MASKED***"
    assert got[4] == "mail jo***@example.com now" and got[5] == "call 555-***-4567" and got[7] == "nothing here"


def test_hits_and_verdicts(sensitive):
    hits = {(r["id"], r["detail"]): r for r in safety.hits(sensitive, ["id"], "text").collect()}
    assert hits[(1, "ssn")]["evidence"] == "123-***" and hits[(6, "api_key")]["evidence"] == "abcdefghij..."
    assert hits[(9, "password")]["severity"] == "critical" and (9, "fraud") in hits and (9, "illegal") in hits
    assert (8, "suspicious_amounts") in hits
    v = {r["id"]: r for r in safety.verdicts(sensitive, ["id"], "text").collect()}
    assert v[7]["is_safe"] and v[7]["risk_score"] == 0.0
    assert not v[6]["is_safe"] and v[1]["risk_score"] == pytest.approx(0.7 * 0.85)


def test_sanitise_nested(spark):
    df = spark.sql("SELECT named_struct('a', ' <b>x</b> ', 'l', array('(y)', 'z;'), 'm', map('k', '\"q\"'), 'n', 3) AS v")
    out = df.select(safety.sanitize_nested(F.col("v"), df.schema["v"].dataType).alias("v")).first()["v"]
    assert out["a"] == "bx/b" and out["l"] == ["y", "z"] and out["m"] == {"k": "q"} and out["n"] == 3


def test_access_rules(spark):
    rows = [("admin_1", "ledger", "delete", True), ("auditor_2", "ledger", "audit", True), ("auditor_2", "ledger", "write", False),
            ("user_3", "reports", "read", True), ("user_3", "ledger", "read", False), ("user_3", "reports", "write", False)]
    df = spark.createDataFrame(rows, "u string, r string, a string, want boolean")
    assert df.where(safety.allowed(F.col("u"), F.col("r"), F.col("a")) != F.col("want")).count() == 0


def test_advice_scans_the_texts_once(spark, sf_dir):
    import tallyscope.plans.catalog  # noqa: F401
    from tallyscope.plans.registry import QUERIES

    plan = QUERIES["t11_security_advice"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
