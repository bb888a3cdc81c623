"""Known values and invariances of the digit and word laws."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyscope.functions.chi2 import p_value
from tallyscope.functions.digits import digit_pair, integer_digit, significant_digit
from tallyscope.functions.text import words
from tallyscope.operators import digit_law as dl
from tallyscope.operators import word_law as wl


def amounts(spark, xs, key="a"):
    return spark.createDataFrame([(key, None if x is None else float(x)) for x in xs], "k string, amount double")


def test_conforming_amounts_pass(spark):
    xs = [d * 100 for d in range(1, 10) for _ in range(int(math.log10(1 + 1 / d) * 1000))]
    r = dl.engine_test(amounts(spark, xs), ["k"], "amount").first()
    assert not r["is_significant"] and r["risk_score"] < 0.3


def test_one_digit_only_fails(spark):
    r = dl.engine_test(amounts(spark, range(1000, 2000, 10)), ["k"], "amount").first()
    assert r["is_significant"] and r["risk_score"] == 1.0 and 1 in r["anomalous_digits"]


@pytest.mark.parametrize("xs,n", [([123.45, 678.90, 111.11], 3), ([100, -50, 200, -75, 300], 5), ([0, 100, 0, 200, 0, 300], 3)])
def test_sample_sizes(spark, xs, n):
    assert dl.engine_test(amounts(spark, xs), ["k"], "amount").first()["sample_size"] == n


def test_digit_forms(spark):
    xs = [12345678.9, 0.00347, -52.1, 1e15, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    c = F.col("x")
    rows = df.select(integer_digit(c).alias("i"), integer_digit(c, 2).alias("j"), significant_digit(c).alias("s"), digit_pair(c).alias("p")).collect()
    assert [r["i"] for r in rows] == [1, 0, 5, 1, 9]
    assert [r["j"] for r in rows] == [2, None, 2, 0, None]
    assert [r["s"] for r in rows] == [1, 3, 5, 1, 9]
    assert rows[1]["p"] is None and tuple(rows[4]["p"]) == (9, 0)
    with pytest.raises(ValueError):
        integer_digit(c, 3)


def test_scaling_and_order_change_nothing(spark):
    rng = random.Random(42)
    xs = [round(10 ** rng.uniform(0, 5), 2) for _ in range(2000)]
    a = dl.engine_test(amounts(spark, xs), ["k"], "amount").drop("digit_position").first()
    b = dl.engine_test(amounts(spark, [x * 10 for x in xs]).repartition(7), ["k"], "amount").drop("digit_position").first()
    assert a["sample_size"] == b["sample_size"] and a["chi_square"] == pytest.approx(b["chi_square"], rel=1e-9)


def test_chi_square_tail(spark):
    df = spark.createDataFrame([(15.507, 20.090, 16.919, 21.666)], "a double, b double, c double, d double")
    r = df.select(p_value(F.col("a"), 8), p_value(F.col("b"), 8), p_value(F.col("c"), 9), p_value(F.col("d"), 9)).first()
    assert list(r) == pytest.approx([0.05, 0.01, 0.05, 0.01], abs=1e-5)


def test_conditional_law_forms(spark):
    exact = dl.conditional_expected(spark).groupBy("d1").agg(F.sum("expected").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in exact)
    ref = dl.conditional_expected(spark, "reference").where("d1 = 1 and digit = 0").first()["expected"]
    assert ref == pytest.approx(sum(math.log10(1 + 1 / (10 + k * 100)) for k in range(10)))


def test_two_digit_classes(spark):
    xs = [float(f"{i}{j}") for i in range(1, 10) for j in range(10)] * 2
    r = dl.two_digit_test(amounts(spark, xs), ["k"], "amount").first()
    assert r["sample_size"] == 180 and r["empty_classes"] == 0


def test_few_values_give_no_row(spark):
    assert dl.significant_test(amounts(spark, [1, 2, 3]), ["k"], "amount").count() == 0


def test_words_follow_unicode_boundaries(spark):
    df = spark.createDataFrame([("The naïve INVOICE, invoice_2 total; it's  über cost5 fee",)], "t string")
    assert df.select(words(F.col("t"))).first()[0] == ["the", "invoice", "total", "fee"]
    assert df.select(words(F.col("t"), 3, True)).first()[0] == ["invoice", "total", "fee"]


def test_vendor_law_needs_twenty_vendors(spark):
    rows = [("s", "Vendor_A", 1000.0)] * 50 + [("s", f"Vendor_{i}", 10.0) for i in range(1, 21)] + [("t", f"V{i}", 5.0) for i in range(5)]
    out = wl.vendor_zipf(spark.createDataFrame(rows, "k string, vendor_name string, amount double"), ["k"]).collect()
    assert [r["k"] for r in out] == ["s"] and out[0]["top_share"] > 0.99 and out[0]["items"] == 21
