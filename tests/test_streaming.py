"""Streams over many files give what the same operator gives on the batch."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyscope.operators.ordered import top_n, trailing_count
from tallyscope.session import scratch_path
from tallyscope.streaming import alerts as al
from tallyscope.streaming import runner as ru
from tallyscope.streaming import state as st

SCHEMA = "id long, ts timestamp, user long, value double"


@pytest.fixture(scope="module")
def replay(spark):
    """1,500 events in time order over ten files, one user with a third of them."""
    rng, t, rows = random.Random(42), dt.datetime(2024, 1, 1), []
    for i in range(1500):
        t += dt.timedelta(seconds=rng.choice([1, 2, 5, 20, 90]))
        rows.append((i, t, 1 if i % 3 == 0 else rng.randrange(2, 9), rng.uniform(0, 5)))
    path = scratch_path(spark, "replay")
    for n in range(10):
        spark.createDataFrame(rows[n * 150 : (n + 1) * 150], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.schema(SCHEMA).parquet(path)


@pytest.fixture(scope="module")
def shuffled(spark, replay):
    """The same events with delays of up to nine minutes, in the files in which they arrive."""
    _, batch = replay
    rng = random.Random(3)
    late = sorted(batch.collect(), key=lambda r: r.ts + dt.timedelta(seconds=rng.randrange(540)))
    path = scratch_path(spark, "shuffled")
    for n in range(8):
        spark.createDataFrame(late[n * 190 : (n + 1) * 190], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.schema(SCHEMA).parquet(path)


def stream(spark, path):
    return ru.read_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, per_trigger=2)


def closed(df, batch, delay=600, size=300):
    """Windows that end before the final watermark."""
    last = batch.agg(F.max(F.unix_seconds("ts"))).first()[0]
    return df.where(F.unix_seconds("window_start") + size <= last - delay)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("operator", [
    lambda df: al.failure_bursts(df, "ts", "user", 4),
    lambda df: al.count_above(df, "ts", "5 minutes", 5, ["user"]),
    lambda df: al.error_rate(df, "ts", 0.01, ["user"]),
])
def test_windows_batch_equals_stream(spark, replay, operator):
    path, batch = replay
    out = ru.run_available(operator(stream(spark, path)), "windows")
    want = rows(closed(operator(batch), batch))
    assert want and rows(closed(out, batch)) == want


def test_slow_windows_and_accuracy(spark, replay):
    path, batch = replay
    out = ru.run_available(al.slow_windows(stream(spark, path), "ts", "value", 2.0), "slow")
    assert rows(closed(out, batch)) == rows(closed(al.slow_windows(batch, "ts", "value", 2.0), batch))


def test_stalls_batch_equals_stream(spark, replay):
    path, batch = replay
    want = {(r["user"], r["active_from"]): r["started"] for r in al.activity_sessions(batch, "ts", ["user"], "3 minutes").collect()}
    got = {(r["user"], r["active_from"]): r["started"] for r in ru.run_available(al.activity_sessions(stream(spark, path), "ts", ["user"], "3 minutes"), "stall").collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 20


def test_trailing_bursts_are_exact(spark, replay):
    path, batch = replay
    out = ru.run_available(ru.trailing_bursts(stream(spark, path), "user", "ts", 10, delay="0 seconds"), "bursts")
    want = trailing_count(batch.select("user", F.unix_micros("ts").alias("us")), ["user"], "us", 300).where("recent >= 10")
    assert rows(out.select("user", "us", "recent")) == rows(want.select("user", "us", "recent"))


def test_trailing_bursts_count_late_rows(spark):
    """Rows up to ten minutes late, in files of their own, count as if they had come in order; later ones do not."""
    rng, start = random.Random(7), dt.datetime(2024, 1, 1)
    late = [(i, start + dt.timedelta(seconds=20 * i), i % 2, 0.0) for i in range(600)]
    late.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(0, 500)))
    late.append((999, start, 0, 0.0))  # hours late
    late += [(1000, start + dt.timedelta(days=1), 0, 0.0), (1001, start + dt.timedelta(days=2), 0, 0.0)]
    path = scratch_path(spark, "late")
    for n in range(0, 601, 100):
        spark.createDataFrame(late[n : n + 100], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    out = ru.run_available(ru.trailing_bursts(stream(spark, path), "user", "ts", 5), "late-bursts")
    kept = spark.createDataFrame([r for r in late if r[0] < 600], SCHEMA)
    want = trailing_count(kept.select("user", F.unix_micros("ts").alias("us")), ["user"], "us", 300).where("recent >= 5")
    assert want.count() > 100 and rows(out.select("user", "us", "recent")) == rows(want.select("user", "us", "recent"))


def test_trailing_bursts_to_the_end_of_the_stream(spark, shuffled):
    """Files out of order within the delay, several batches; no event of the tail is left unjudged."""
    path, batch = shuffled
    out = ru.run_to_end(lambda: stream(spark, path), "ts", lambda e: ru.trailing_bursts(e, "user", "ts", 6), "tail")
    want = trailing_count(batch.select("user", F.unix_micros("ts").alias("us")), ["user"], "us", 300).where("recent >= 6")
    last = want.agg(F.max("us")).first()[0]
    assert want.where(F.col("us") > last - 600_000_000).count() > 0
    assert rows(out.select("user", "us", "recent")) == rows(want.select("user", "us", "recent"))


HELD = {
    "denials": (lambda df, **k: al.count_above(df, "ts", "1 minute", 1, ["user"], **k), ["user"], 60, 60, 60),
    "slow": (lambda df, **k: al.slow_windows(df, "ts", "value", 4.0, ["user"], "5 minutes", **k), ["user"], 300, 300, 300),
    "errors": (lambda df, **k: al.error_rate(df, "ts", 0.03, size_seconds=300, slide="1 minute", error=F.col("value") > 2, **k), [], 60, 120, 300),
}


@pytest.mark.parametrize("name", sorted(HELD))
def test_alerts_hold_on_streams(spark, shuffled, name):
    """Late rows, several batches, a restart in between: the stream resolves the runs that the batch finds, and fires each once."""
    path, batch = shuffled
    windows, keys, step, hold, size = HELD[name]
    want = rows(al.held(windows(batch), F.lit(True), keys, step, hold).select(*keys, "from_s", "to_s", "windows"))
    assert len(want) > 1

    def build(e):
        return st.held_events(windows(e, keep=True), F.lit(True), keys, step, hold, size)

    place, some = scratch_path(spark, "held"), scratch_path(spark, "part")
    files = sorted(batch.inputFiles(), key=lambda f: os.path.getmtime(f.removeprefix("file://")))  # as they arrived
    spark.read.schema(batch.schema).parquet(*files[:4]).coalesce(1).write.parquet(some)
    read = lambda: stream(spark, some)
    ru.run_so_far(read, "ts", build, "held", place)
    for f in files[4:]:
        spark.read.schema(batch.schema).parquet(f).coalesce(1).write.mode("append").parquet(some)
    out = ru.run_to_end(read, "ts", build, "held", path=place)
    assert rows(out.where("event = 'resolved'").drop("event")) == want
    fired = rows(out.where("event = 'firing'").select(*keys, "from_s", "to_s"))
    steps = -(-hold // step)
    assert fired == sorted((*r[:-3], r[-3], r[-3] + steps * step) for r in want)


def test_silence_on_a_stream(spark):
    """One instance stops for good, one pauses, one never starts; each batch of the stream is a file."""
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    heard = [("a", 600 * k) for k in range(20)] + [("b", 600 * k) for k in range(4)] + [("c", 600 * k) for k in range(20) if not 5 <= k < 8]
    heard += [("a", 600 * k + 30) for k in range(20)]
    metrics = [(at(s), "audits_started", 1.0, h) for h, s in sorted(heard, key=lambda x: (x[1] % 1800, x[1]))]
    metrics += [(at(60 * k), "cpu_percent", 99.0 if 10 <= k < 30 else 5.0, "a") for k in range(150)]
    schema = "ts timestamp, metric string, value double, host string"
    due = spark.createDataFrame([(at(0), "AuditProcessingStalled", h) for h in "abcd"], "ts timestamp, rule string, host string")
    rules = al.alert_rules(spark)
    batch = spark.createDataFrame(metrics, schema)
    until = at(14_000)
    want = al.metric_alerts(batch, rules, ["host"], F.lit(until).cast("timestamp"), due)
    runs = {(r.host, r.rule, r.from_s, r.to_s, r.windows) for r in want.collect()}
    assert {(h, r) for h, r, *_ in runs} == {("a", "AuditProcessingStalled"), ("b", "AuditProcessingStalled"), ("c", "AuditProcessingStalled"), ("d", "AuditProcessingStalled"), ("a", "HighCPUUsage")}
    path, expected = scratch_path(spark, "metrics"), scratch_path(spark, "expected")
    for n in range(0, len(metrics), 60):
        spark.createDataFrame(metrics[n : n + 60], schema).coalesce(1).write.mode("append").parquet(path)
    due.coalesce(1).write.parquet(expected)

    def read():
        return st.announced(ru.read_stream(spark, path, batch.schema, per_trigger=2), ru.read_stream(spark, expected, due.schema), ["host"])

    out = ru.run_to_end(read, "ts", lambda m: st.metric_events(m, ["host"]), "silence", delay="3 hours", until=until).collect()
    fired = {(r.host, r.rule, r.from_s) for r in out if r.event == "firing"}
    assert len(fired) == len([r for r in out if r.event == "firing"]) and fired == {r[:3] for r in runs}
    done = {(r.host, r.rule, r.from_s, r.to_s, r.windows) for r in out if r.event == "resolved"}
    size = {r[0]: r[2] for r in al.ALERT_RULES}
    assert done == {r for r in runs if r[3] + 2 * size[r[1]] <= until.timestamp()}


def test_percentile_of_a_window_of_a_million_values(spark):
    """Judged as the value at rank ceil(0.95 n), on either side of the bound by one value."""
    n = 1_000_003
    for above, slow in ((50_000, False), (50_001, True)):
        df = spark.range(n).select(F.timestamp_seconds(F.col("id") % 300).alias("ts"), F.when(F.col("id") < above, 3.0).otherwise(F.col("id") / n).alias("value"))
        found = al.slow_windows(df, "ts", "value", 2.0).collect()
        assert [(r.n, r.above) for r in found] == ([(n, above)] if slow else [])
    for op, bound, hit in ((">", 0.9, True), ("<", 0.96, True), ("<", 0.94, False), ("<=", 0.2, False)):
        df = spark.range(1000).select(F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit("m").alias("metric"), (F.col("id") / 1000).alias("value"))
        rule = al.alert_rules(spark, [("R", "m", 300, "p95", op, bound, 0, "x")])
        assert bool(al.metric_alerts(df, rule).count()) == hit


def test_newest_survives_a_restart_without_input(spark, replay):
    path, _ = replay
    place = scratch_path(spark, "again")
    first = rows(ru.newest(stream(spark, path), ["user"], "ts", "id", 3, place))
    assert rows(ru.newest(stream(spark, path), ["user"], "ts", "id", 3, place)) == first


def test_newest_over_batches(spark, replay):
    path, batch = replay
    out = ru.newest(stream(spark, path), ["user"], "ts", "id", 10, scratch_path(spark, "newest"))
    want = top_n(batch, ["user"], [F.col("ts").desc(), F.col("id").desc()], 10).drop("rank")
    assert rows(out.select("user", "id")) == rows(want.select("user", "id"))


def test_feedback_join(spark, replay):
    path, batch = replay

    def sides(df):
        preds = df.select("id", F.col("ts").alias("predicted_at"), (F.col("value") > 2).alias("is_anomaly"), (F.col("value") / 5).alias("confidence"))
        late = F.timestamp_micros(F.unix_micros("ts") + (F.col("id") % 120) * 60_000_000)
        return preds, df.where("id % 2 = 0").select("id", late.alias("feedback_at"), F.lit("ok").alias("human_feedback"))

    p, f = sides(stream(spark, path)), sides(stream(spark, path))
    out = ru.run_available(ru.feedback_join(p[0], f[1], "id"), "feedback")
    assert rows(out) == rows(ru.feedback_join(*sides(batch), "id"))


def test_audit_trail_partitions_by_day(spark, replay):
    path, batch = replay
    base = scratch_path(spark, "trail")
    ru.audit_trail(stream(spark, path), "ts", f"{base}/rows", f"{base}/cp").awaitTermination()
    back = spark.read.parquet(f"{base}/rows")
    assert back.count() == 1500 and back.where("datediff(expires, day) <> 2555").count() == 0


def test_held_needs_consecutive_windows(spark):
    rows_ = [("a", s, 20 if s in (0, 60, 120, 300) else 1) for s in range(0, 600, 60)]
    df = spark.createDataFrame(rows_, "k string, s long, n int").withColumn("window_start", F.timestamp_seconds("s"))
    got = al.held(df, F.col("n") > 10, ["k"], 60, 60).collect()
    assert [(r["from_s"], r["to_s"], r["windows"]) for r in got] == [(0, 120, 3)]


def test_instance_that_stops_for_good_fires(spark):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    rows = [(at(600 * k), "audits_started", 1.0, "a") for k in range(10)] + [(at(600 * k), "audits_started", 1.0, "b") for k in range(3)]
    df = spark.createDataFrame(rows, "ts timestamp, metric string, value double, host string")
    zero = int(at(0).timestamp())

    def fired(**more):
        out = al.metric_alerts(df, al.alert_rules(spark), ["host"], **more)
        return {(r.host, r.rule, r.from_s - zero, r.to_s - zero, r.windows) for r in out.collect()}

    assert fired() == set()
    assert fired(until=F.timestamp_seconds(F.lit(zero + 6000))) == {("b", "AuditProcessingStalled", 1800, 5400, 7)}
    # judged in the middle of the window from 7200 on: that one is still open
    later = fired(until=F.timestamp_seconds(F.lit(zero + 7500)))
    assert later == {("b", "AuditProcessingStalled", 1800, 6600, 9), ("a", "AuditProcessingStalled", 6000, 6600, 2)}
