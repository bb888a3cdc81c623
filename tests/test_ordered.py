"""Range-cut scans equal plain windows, also with a group of a third of all rows."""

import datetime as dt
import decimal
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyscope.operators import ordered
from tallyscope.operators.ordered import down, ntile, scan, trailing_count
from tallyscope.operators.quantiles import exact_percentiles, with_median_gap
from tallyscope.operators.features import similar_amounts


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(42)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        rows.append((i, g, rng.randrange(50), round(rng.uniform(-100, 100), 2) if i % 7 else None))
    return spark.createDataFrame(rows, "id long, g string, t int, x double").repartition(5)


OPTIONS = dict(number="n", total="all", sums={"s": "x2"}, maxes={"m": "x"})


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    """Buckets of a few rows, so that small tables are cut."""
    monkeypatch.setattr(ordered, "LEAST_ROWS", 20)


def against_window(df, group, order, sort, **options):
    cut = scan(df, group, order, **options)
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy(*sort)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    added = {
        "number": lambda new: [F.row_number().over(w).cast("bigint").alias(new)],
        "total": lambda new: [F.count(F.lit(1)).over(Window.partitionBy(*(group or [F.lit(1)]))).alias(new)],
        "sums": lambda d: [F.sum(c).over(upto).alias(new) for new, c in d.items()],
        "maxes": lambda d: [F.max(c).over(upto).alias(new) for new, c in d.items()],
        "previous": lambda d: [F.lag(c).over(w).alias(new) for new, c in d.items()],
    }
    plain = df.select("*", *[c for k, v in options.items() for c in added[k](v)])
    key = lambda r: r["id"]
    a, b = (sorted(x.collect(), key=key) for x in (cut, plain.select(*cut.columns)))
    assert list(map(repr, a)) == list(map(repr, b))  # NaN is NaN here


@pytest.mark.parametrize("group", [["g"], []])
def test_range_cut_equals_window(skewed, group):
    df = skewed.withColumn("x2", F.col("x").cast("decimal(20,2)"))
    against_window(df, group, [down(F.col("t")), F.col("id")], [F.col("t").desc(), F.col("id")], **OPTIONS)
    against_window(df, group, [F.col("t"), F.col("id")], [F.col("t"), F.col("id")], previous={"p": "x"}, **OPTIONS)
    against_window(df, group, [F.col("x"), down(F.col("id"))], [F.col("x"), F.col("id").desc()], **OPTIONS)


@pytest.mark.parametrize("kind", ["double", "string", "timestamp", "date", "boolean", "decimal(20,3)"])
def test_order_keys_of_every_type(spark, kind):
    """Nulls, NaN, one outlier, values that crowd, and a value that a third of the rows have."""
    rng = random.Random(9)
    values = {
        "double": lambda i: rng.choice([None, float("nan"), 1e300, -1e300, float("inf"), 5.0, 5.0, 5.0, 1e9 + i / 1e4, rng.gauss(0, 1)]),
        "string": lambda i: rng.choice([None, "", "same", "same", f"é{i}", f"prefix-{rng.randrange(900)}", "\U0001F600", chr(rng.randrange(1, 0xD000))]),
        "timestamp": lambda i: rng.choice([None, dt.datetime(1900, 1, 1), dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(10**6))]),
        "date": lambda i: rng.choice([None, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(40))]),
        "boolean": lambda i: rng.choice([None, True, False, False]),
        "decimal(20,3)": lambda i: rng.choice([None, decimal.Decimal("12345678901234567.891"), decimal.Decimal(rng.randrange(10**6)) / 1000]),
    }[kind]
    df = spark.createDataFrame([(i, values(i)) for i in range(1500)], f"id long, v {kind}").repartition(3)
    if kind == "double":
        df = df.withColumn("v", F.when(F.col("id") % 97 == 0, F.lit(float("-inf"))).otherwise(F.col("v")))
    options = dict(number="n", total="all", sums={"s": "id"})
    against_window(df, [], [F.col("v"), F.col("id")], [F.col("v"), F.col("id")], previous={"p": "id"}, **options)
    against_window(df, [], [down(F.col("v")), F.col("id")], [F.col("v").desc(), F.col("id")], **options)


@pytest.mark.parametrize("values", [
    "id", "id * id * id", "exp(id / 50.0)", "CASE WHEN id < 3 THEN 1e15 ELSE id END", "CASE WHEN id % 3 = 0 THEN 7 ELSE -1 / (id + 1.0) END", "1",
])
def test_buckets_stay_small(spark, values):
    """However values crowd, no bucket gets more than a few times the wanted rows; ties are cut by the next key."""
    df = spark.range(20_000).selectExpr("id", f"CAST({values} AS DOUBLE) AS v")
    cut = ordered.Buckets(df, [], [F.col("v"), F.col("id")])
    sizes = [r["count"] for r in cut.rows.groupBy("_bucket").count().collect()]
    assert max(sizes) <= 3 * cut.target and len(sizes) <= 60_000 / cut.target
    known = {r["_bucket"]: r["_n"] for r in cut.table.collect()}
    assert known == {r["_bucket"]: r["count"] for r in cut.rows.groupBy("_bucket").count().collect()}


def test_rows_are_shuffled_once(skewed):
    """One exchange of the rows, no join by group, nothing written but counts."""
    out = scan(skewed, ["g"], [F.col("t"), F.col("id")], number="n", total="all")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan
    exchanges, broadcast = 0, None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if broadcast is not None and depth <= broadcast:
            broadcast = None
        if broadcast is None:
            broadcast = depth if "BroadcastExchange" in line else None
            exchanges += "Exchange hashpartitioning" in line
    assert exchanges == 1  # others are below the broadcast table of buckets


def test_ntile_equals_builtin(spark):
    from pyspark.sql import Window

    for n in (3, 10, 23, 100):
        df = spark.range(n).withColumn("n", F.col("id") + 1).withColumn("all", F.lit(n))
        w = Window.partitionBy(F.lit(0)).orderBy("id")
        bad = df.select(ntile(F.col("n"), F.col("all"), 10).alias("a"), F.ntile(10).over(w).cast("bigint").alias("b")).where("a <> b")
        assert bad.count() == 0


def test_trailing_count(spark):
    rng = random.Random(1)
    rows = [(i, "u" if i % 3 else f"v{i % 5}", rng.randrange(0, 20_000_000_000)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, k string, us long")
    got = {r["id"]: r["recent"] for r in trailing_count(df, ["k"], "us", 300).collect()}
    for i, k, u in rows:
        assert got[i] == sum(1 for _, k2, u2 in rows if k2 == k and u - 300_000_000 < u2 <= u)


def test_percentiles_match_numpy(skewed):
    probs = {"a": 0.0, "b": 0.025, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}
    got = {r["g"]: r for r in exact_percentiles(skewed, ["g"], "x", probs).collect()}
    by = {}
    for r in skewed.collect():
        if r["x"] is not None:
            by.setdefault(r["g"], []).append(r["x"])
    assert set(got) == set(by)
    for g, xs in by.items():
        assert got[g]["n"] == len(xs)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(xs, p * 100), abs=1e-9)


def test_percentiles_with_one_dominant_value(spark):
    xs = [5.0] * 500 + [float(i) for i in range(100)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    r = exact_percentiles(df, [], "x", {"q": 0.5, "h": 0.93}).first()
    assert r["q"] == np.percentile(xs, 50) and r["h"] == pytest.approx(np.percentile(xs, 93))


def test_median_gap(skewed):
    xs = np.array([r["x"] for r in skewed.collect() if r["x"] is not None])
    r = with_median_gap(skewed, [], "x").first()
    assert r["median"] == pytest.approx(np.median(xs))
    assert r["mad"] == pytest.approx(np.median(np.abs(xs - np.median(xs))))


def test_similar_amounts_brute_force(spark):
    rng = random.Random(3)
    xs = [round(rng.choice([100, 101, 99.5, rng.uniform(-50, 300), 0]), 2) for _ in range(400)]
    df = spark.createDataFrame([(float(x),) for x in xs], "amount double")
    got = {float(r["amount"]): r["similar"] for r in similar_amounts(df, [], "amount").collect()}
    cents = [round(x * 100) for x in xs]
    for x in set(cents):
        want = sum(1 for y in cents if abs(y - x) * 100 <= x) if x >= 0 else 0
        assert got[x / 100] == want


def test_amounts_are_placed_as_whole_numbers_where_they_fit(spark, monkeypatch):
    from decimal import Decimal

    from tallyscope.operators import features

    kinds, scan = [], features.scan
    monkeypatch.setattr(features, "scan", lambda df, *a, **b: kinds.append(dict(df.dtypes)["x"]) or scan(df, *a, **b))
    small = [Decimal(x) for x in ("100.00", "101.00", "101.01", "99.01", "99.00", "-5.00", "0.00", "0.01")]
    for factor in (1, 10**13):
        rows = [("a", x * factor) for x in small] + [("a", None), (None, Decimal("1.00"))]
        got = {r["amount"]: r["similar"] for r in similar_amounts(spark.createDataFrame(rows, "g string, amount decimal(20,2)").where("g is not null and amount is not null"), ["g"], "amount").collect()}
        assert got == {x * factor: sum(abs(y - x) * 100 <= x for y in small) if x >= 0 else 0 for x in small}
        df = spark.createDataFrame(rows, "g string, amount decimal(20,2)")
        assert features.amount_frequency(df, ["g"], "amount").count() == len(small)
    assert kinds[0] == kinds[1] == "bigint" and kinds[2] == kinds[3] == "decimal(26,6)"


def test_statistics_of_few_groups_are_broadcast(spark, monkeypatch):
    from tallyscope.operators import quantiles, stats

    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 2.0, 3), (None, 1.0, 4)], "g string, x double, id long")
    monkeypatch.setattr(quantiles, "FEW_GROUPS", quantiles.FEW_GROUPS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (quantiles.FEW_GROUPS, 1):
            monkeypatch.setattr(quantiles, "FEW_GROUPS", few)
            out = stats.z_scores(df, ["g"], "x")
            assert ("SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()) == (few == 1)
            assert {r["id"]: r["z"] for r in out.collect()} == {1: pytest.approx(-(0.5**0.5)), 2: pytest.approx(0.5**0.5), 3: 0.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages(skewed):
    from tallyscope.operators import sessions

    order = [down(F.col("t")), F.col("id")]
    rows = sorted(((-r["t"], r["id"]) for r in skewed.select("id", "t").collect()))
    got = sessions.page(skewed.select("id", "t"), order, 3, 50).orderBy("row").collect()
    assert [(-r["t"], r["id"]) for r in got] == rows[100:150]
    assert [r["row"] for r in got] == list(range(101, 151)) and got[0]["pages"] == 60 and got[0]["has_next"] and got[0]["has_prev"]
    for number in (1, 7, 60, 61):
        page = sessions.page(skewed.select("id", "t"), order, number, 50).orderBy("row").collect()
        assert [(-r["t"], r["id"]) for r in page] == rows[(number - 1) * 50 : number * 50]
    plan = sessions.page(skewed.select("id", "t"), order, 3, 50)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # only the rows of the buckets that hold the page go on


def test_percentiles_of_crowded_values(spark):
    """A million different values within a thousandth of one another: no ranking task gets more than a small share."""
    from tallyscope.operators import quantiles

    df = spark.range(1_000_000).select((F.lit(1e6) + F.col("id") / 1000).alias("x"))
    row = quantiles.exact_percentiles(df, [], "x", {"a": 0.25, "b": 0.5}).first()
    assert row["a"] == pytest.approx(1e6 + 249.99975) and row["b"] == pytest.approx(1e6 + 499.9995)
    assert quantiles.largest_ranked(df, [], "x", {"a": 0.25, "b": 0.5}) < 5_000


def test_top_n_is_cut_before_the_shuffle(skewed):
    from tallyscope.operators.ordered import top_n

    plan = top_n(skewed, ["g"], [F.col("x").desc(), F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scans_read_only_what_they_need(spark, sf_dir):
    from tallyscope.operators.sessions import transaction_stats
    from tallyscope.plans import views

    df = transaction_stats(views.ledger(spark, sf_dir, "session_id", "amount"), ["session_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan and "supplier" not in plan
