"""Windowed alerts as DataFrame -> DataFrame functions that run on batches and on streams.

The window functions below have no batch-only step. ``held`` (a breach sustained over
several windows) and ``metric_alerts`` are the batch forms; ``state`` has their streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.constants import ALERT_RULES
from tallyscope.operators.ordered import scan


def watermarked(df: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Watermark for streams that have none yet; a batch ignores it."""
    return df.withWatermark(ts, delay) if df.isStreaming and "spark.watermarkDelayMs" not in df.schema[ts].metadata else df


def windowed(df: DataFrame, ts: str, size: str, keys: Sequence[str], *aggs: Column, slide: str | None = None, delay: str = "10 minutes", keep: bool = False) -> DataFrame:
    """Tumbling or sliding windows with ``window_start`` in front; ``keep``: the ``window`` in its place, for further state."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = watermarked(df, ts, delay).groupBy(win.alias("window"), *keys).agg(*aggs)
    first = F.col("window") if keep else F.col("window.start").alias("window_start")
    return out.select(first, *keys, *[c for c in out.columns if c not in ("window", *keys)])


def above_share(value: Column, bound: Column | float, percent: int = 95) -> tuple[Column, Column]:
    """Two counts that tell exactly, for a window of any size, whether a percentile exceeds a bound.

    The percentile is the value at rank ceil(percent * n / 100). It exceeds the bound if fewer values than
    that rank do not: counts add up over tasks and batches, and no value is kept.
    """
    return F.count(value).alias("n"), F.count_if(value > bound).alias("above")


def exceeds(n: Column, above: Column, percent: int = 95) -> Column:
    return n - above < F.floor((n * percent + 99) / 100)


def failure_bursts(df: DataFrame, ts: str, user: str, least: int = 10, slide: str = "1 minute") -> DataFrame:
    """Users with at least ``least`` failures inside a sliding five-minute window."""
    return windowed(df, ts, "5 minutes", [user], F.count(F.lit(1)).alias("attempts"), slide=slide).where(F.col("attempts") >= least)


def count_above(df: DataFrame, ts: str, size: str, bound: int, keys: Sequence[str] = (), keep: bool = False) -> DataFrame:
    """Tumbling windows with more than ``bound`` rows."""
    return windowed(df, ts, size, keys, F.count(F.lit(1)).alias("n"), keep=keep).where(F.col("n") > bound)


def error_rate(
    df: DataFrame, ts: str, bound: float = 0.1, keys: Sequence[str] = (), size_seconds: int = 300, slide: str = "1 minute",
    error: Column | None = None, keep: bool = False,
) -> DataFrame:
    """Sliding windows with more than ``bound`` rows a second; of those where ``error`` holds, if given."""
    many = F.count(F.lit(1)) if error is None else F.count_if(error)
    out = windowed(df, ts, f"{size_seconds} seconds", keys, many.alias("n"), slide=slide, keep=keep)
    return out.withColumn("rate", F.col("n") / size_seconds).where(F.col("rate") > bound)


def slow_windows(df: DataFrame, ts: str, value: str, bound: float, keys: Sequence[str] = (), size: str = "5 minutes", keep: bool = False) -> DataFrame:
    """Windows whose 95th percentile exceeds ``bound``, judged exactly from the numbers of values in all and ``above``."""
    return windowed(df, ts, size, keys, *above_share(F.col(value), bound), keep=keep).where(exceeds(F.col("n"), F.col("above")))


def low_accuracy(df: DataFrame, ts: str, predicted: str, label: str, bound: float = 0.85, keys: Sequence[str] = (), size: str = "1 hour") -> DataFrame:
    right = (F.col(predicted) == F.col(label)).cast("double")
    return windowed(df, ts, size, keys, F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n")).where(F.col("accuracy") < bound)


def activity_sessions(df: DataFrame, ts: str, keys: Sequence[str], gap: str = "10 minutes") -> DataFrame:
    """Stretches of starts with no pause of ``gap``; the end of a stretch is where work stalls."""
    out = watermarked(df, ts).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("started"))
    # session_window ends ``gap`` after the last row
    return out.select(*keys, F.col("w.start").alias("active_from"), F.col("w.end").alias("stalled_at"), "started")


def stalled_while_pending(stretches: DataFrame, work: DataFrame, keys: Sequence[str], created: str = "created", finished: str = "finished") -> DataFrame:
    """Ends of the stretches of ``activity_sessions`` at which work is pending: created by then and not finished.

    Creations, finishes and ends meet in one ordered running sum, so no item is paired with an end.
    """
    keys = list(keys)
    rows = (
        work.select(*keys, F.unix_micros(created).alias("_us"), F.lit(0).alias("_kind"), F.lit(1).alias("_add"))
        .unionByName(work.where(F.col(finished).isNotNull()).select(*keys, F.unix_micros(finished).alias("_us"), F.lit(0).alias("_kind"), F.lit(-1).alias("_add")))
        .groupBy(*keys, "_us", "_kind").agg(F.sum("_add").alias("_add"))
        .unionByName(stretches.select(*keys, F.unix_micros("stalled_at").alias("_us"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_add")))
    )
    counted = scan(rows, keys, [F.col("_us"), F.col("_kind")], sums={"pending": "_add"})
    return counted.where((F.col("_kind") == 1) & (F.col("pending") > 0)).select(*keys, F.timestamp_micros("_us").alias("stalled_at"), "pending")


def held(windows: DataFrame, breached: Column, keys: Sequence[str], step_seconds: int, hold_seconds: int) -> DataFrame:
    """Runs of consecutive breached windows that last at least ``hold_seconds`` beyond the first.

    ``windows`` has one row per key and window. Islands come from start time minus rank.
    """
    keys = list(keys)
    hits = windows.where(breached).withColumn("_s", F.unix_seconds(F.col("window_start").cast("timestamp")))
    w = Window.partitionBy(*keys).orderBy("_s") if keys else Window.partitionBy(F.lit(0)).orderBy("_s")
    runs = hits.withColumn("_island", F.col("_s") - F.row_number().over(w) * step_seconds)
    out = runs.groupBy(*keys, "_island").agg(F.min("_s").alias("from_s"), F.max("_s").alias("to_s"), F.count(F.lit(1)).alias("windows"))
    return out.where(F.col("to_s") - F.col("from_s") >= hold_seconds).drop("_island")


def alert_rules(spark: SparkSession, rules: Sequence[tuple] = ALERT_RULES) -> DataFrame:
    return spark.createDataFrame(
        list(rules),
        "rule string, metric string, size_s int, statistic string, comparison string, bound double, hold_s int, severity string",
    )


def is_silence_rule(rule: tuple) -> bool:
    """Whether a rule fires on windows without rows."""
    return rule[3] == "count" and rule[4] == "<="


def fires_on_silence() -> Column:
    return (F.col("statistic") == "count") & (F.col("comparison") == "<=")


def rule_aggregates(counted: Column | None = None) -> list[Column]:
    """What any rule needs of a window; a percentile as the values beyond the rule's own bound."""
    value = F.col("value")
    return [
        (F.count(F.lit(1)) if counted is None else F.count_if(counted)).alias("_count"), F.avg("value").alias("_avg"), F.min("value").alias("_min"),
        F.count("value").alias("_values"), F.count_if(value > F.col("bound")).alias("_above"), F.count_if(value < F.col("bound")).alias("_under"),
    ]


def rule_breached() -> Column:
    """Whether a window's aggregates are on the wrong side of its rule's bound."""
    stat, op, bound = F.col("statistic"), F.col("comparison"), F.col("bound")
    value = (
        F.when(stat == "avg", F.col("_avg")).when(stat == "min", F.col("_min")).when(stat == "rate", F.col("_count") / F.col("size_s"))
        .otherwise(F.col("_count").cast("double"))
    )
    plain = F.when(op == ">", value > bound).when(op == "<", value < bound).when(op == "<=", value <= bound)
    # p95 < bound: the values below the bound reach the rank
    over = exceeds(F.col("_values"), F.col("_above"))
    under = F.col("_under") >= F.floor((F.col("_values") * 95 + 99) / 100)
    percentile = F.when(op == ">", over).when(op == "<", under).when(op == "<=", ~over)
    return F.when(stat == "p95", percentile & (F.col("_values") > 0)).otherwise(plain)


def metric_alerts(
    metrics: DataFrame, rules: DataFrame, keys: Sequence[str] = (), until: Column | None = None, expected: DataFrame | None = None,
) -> DataFrame:
    """Every rule over a (ts, metric, value) table: window by rule and ``keys``, compare, keep sustained breaches.

    ``keys`` name the instance (host, service), so that one in trouble is not hidden by an
    average over all. Rules are a small dimension; their windows are computed in one grouped
    pass. A rule that fires on silence (count at most 0) also gets the windows without rows from
    an instance's first one to the last window that has ended at ``until``, the time of
    judgement, so an instance that stops for good fires; without ``until`` to its own last one.
    ``expected`` lists ``(ts, rule, keys)``: the instance must be heard of from then on, so one
    that never starts fires, too.
    """
    keys = list(keys)
    rows = metrics.join(F.broadcast(rules), "metric")
    size = F.col("size_s")
    rule = ["rule", "severity", "statistic", "comparison", "bound", "size_s", "hold_s"]
    out = rows.groupBy(*keys, *rule, (F.floor(F.unix_seconds("ts") / size) * size).alias("_s")).agg(*rule_aggregates())
    silent = out.where(fires_on_silence())
    known = silent.select(*keys, *rule, "_s")
    if expected is not None:
        due = expected.join(F.broadcast(rules), "rule").where(fires_on_silence())
        known = known.unionByName(due.select(*keys, *rule, (F.floor(F.unix_seconds("ts") / size) * size).alias("_s")))
    spans = known.groupBy(*keys, *rule).agg(F.min("_s").alias("_from"), F.max("_s").alias("_to"))
    if until is not None:
        judged = F.broadcast(metrics.sparkSession.range(1).select(F.unix_seconds(until).alias("_until")))
        ended = (F.floor(F.col("_until") / size) - 1) * size
        spans = spans.crossJoin(judged).withColumn("_to", F.greatest("_to", ended))
    every = spans.select(*keys, *rule, F.explode(F.sequence("_from", "_to", size.cast("bigint"))).alias("_s"))
    gaps = every.join(silent.select(*keys, "rule", "_s"), [*keys, "rule", "_s"], "left_anti").withColumn("_count", F.lit(0).cast("bigint"))
    out = out.unionByName(gaps, allowMissingColumns=True)
    hits = out.where(rule_breached())
    w = Window.partitionBy(*keys, "rule").orderBy("_s")  # one row per window of the rule
    runs = hits.withColumn("_island", F.col("_s") - F.row_number().over(w) * size)
    done = runs.groupBy(*keys, "rule", "severity", "hold_s", "size_s", "_island").agg(
        F.min("_s").alias("from_s"), F.max("_s").alias("to_s"), F.count(F.lit(1)).alias("windows")
    )
    return done.where(F.col("to_s") + size - F.col("from_s") >= F.col("hold_s")).select(*keys, "rule", "severity", "from_s", "to_s", "windows")


def retained(entries: DataFrame, as_of: Column, date: str, critical: Column, days: int) -> DataFrame:
    """Entries no older than ``days``, and every compliance-critical one."""
    return entries.where((F.datediff(as_of, F.col(date)) <= days) | critical)
