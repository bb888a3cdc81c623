"""Appends with defaults, contracts, file scans with encodings, logs."""

import os

import pytest
from pyspark.sql import functions as F

from tallyscope.schemas import TABLES
from tallyscope.sources import contracts, files, tables


def test_append_fills_defaults(spark, tmp_path):
    path = str(tmp_path / "tx")
    rows = spark.createDataFrame([("s", 10.5, None), ("s", 3.25, "EUR")], "audit_session_id string, amount double, currency string")
    rows = rows.withColumn("anomaly_flags", F.create_map(F.lit("a"), F.lit(1)))
    assert tables.append(rows, "transactions", path) == 2
    assert tables.append(rows.limit(1).drop("currency", "anomaly_flags"), "transactions", path) == 1
    back = tables.read(spark, "transactions", path)
    assert back.schema.names == TABLES["transactions"].names and back.count() == 3
    assert {r["currency"] for r in back.collect()} == {"USD", "EUR"}
    assert {r["anomaly_flags"] for r in back.collect()} == {'{"a":1}', "{}"}
    assert back.where("id IS NULL OR created_at IS NULL OR extracted_from_table").count() == 0
    assert tables.duplicate_keys(back, ["id"]).count() == 0


def test_query_result_counts_during_the_write(spark, tmp_path):
    r = tables.run_sql(spark, "SELECT id FROM range(10) WHERE id >= :least", {"least": 4}).write(str(tmp_path / "out"))
    assert r.row_count == 6 and r.columns == ["id"] and r.execution_time > 0


def test_contracts_route_rows(spark):
    rows = [(" Acme ", 2024, 10.0), ("  ", 2024, 10.0), ("B", 1999, 0.0), (None, 2020, None)]
    df = spark.createDataFrame(rows, "client_name string, fiscal_year int, materiality_threshold double")
    good, bad = contracts.split(df, contracts.session_contract())
    assert good.count() == 1 and bad.count() == 3
    assert {len(r["broken"]) for r in bad.collect()} == {1, 2}
    f = spark.createDataFrame([(0.5, 1.0), (1.5, -1.0), (None, None)], "confidence double, financial_impact double")
    assert [len(r["broken"]) for r in contracts.checked(f, contracts.finding_contract()).collect()] == [0, 2, 0]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.txt").write_bytes("Prüfung".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("Prüfung".encode("latin-1"))
    (tmp_path / "c.xyz").write_bytes(b"no")
    (tmp_path / "d.json").write_text('{"b": 1, "a": [1, 2]}')
    csv = tmp_path / "csv"
    csv.mkdir()
    (csv / "x.csv").write_bytes("name,amount\nMüller,1.5\nGroß,2.5\n".encode("latin-1"))
    return tmp_path


def test_discovery_and_quarantine(spark, folder):
    found = files.discover(spark, str(folder))
    assert {os.path.basename(r["path"]) for r in files.quarantined(found).collect()} == {"c.xyz"}
    reasons = {r["reason"] for r in files.quarantined(files.discover(spark, str(folder), max_bytes=10)).collect()}
    assert "file too large" in reasons and files.accepted(found).count() == 4


def test_text_encodings(spark, folder):
    assert [r["text"] for r in files.read_text(spark, str(folder)).collect()] == ["Prüfung", "Prüfung"]


def test_csv_encodings(spark, folder):
    rows = files.read_csv(spark, str(folder / "csv")).orderBy("amount").collect()
    assert [(r["name"], r["amount"]) for r in rows] == [("Müller", 1.5), ("Groß", 2.5)]


def test_csv_encoding_is_chosen_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,note\né,\"two\nlines, \"\"quoted\"\"\"\n".encode())
    (tmp_path / "b.csv").write_bytes("name,note\nü,x\n".encode("latin-1"))
    rows = files.read_csv(spark, str(tmp_path), multiline=True).orderBy("name").collect()
    assert [tuple(r) for r in rows] == [("é", 'two\nlines, "quoted"'), ("ü", "x")]



def test_json_is_reserialised(spark, folder):
    text = files.read_json_text(spark, str(folder)).first()["text"]
    assert text == '{\n  "b": 1,\n  "a": [\n    1,\n    2\n  ]\n}'


def test_profile(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, x double")
    stats, sample = files.profile(df, ["id"])
    r = {s["column"]: s for s in stats.collect()}
    assert r["x"]["mean"] == 9.5 and r["x"]["row_count"] == 20 and sample.count() == 10


def test_feedback_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(2):
        files.append_feedback(spark.createDataFrame([(i, "ok")], "transaction_id int, human_feedback string"), path)
    assert spark.read.json(path).count() == 2


def test_orphans(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "document_id int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert [r[0] for r in tables.orphans(child, parent, "document_id", "id").collect()] == [2]
