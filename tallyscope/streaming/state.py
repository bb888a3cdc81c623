"""Sustained alerts on streams: a state machine per key with event-time timers.

A windowed aggregate closes its windows when the watermark passes them; what it closes goes on
into ``transformWithState``. State is one run per key: where it began, its last window, how many
windows it has and whether it has fired. A run fires as soon as it has lasted long enough, and is
resolved when the next window closes without a breach. No row says so, so a timer does: it is set
to the time at which that window closes, and every further window of the run moves it. An
instance that falls silent works the same way, with the windows without rows as the run.

Rows of one batch are handled before its timers, and timers and windows go by one watermark, so
the events do not depend on how rows come in files and batches. Spark keeps this state in RocksDB,
below the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from tallyscope.constants import ALERT_RULES
from tallyscope.streaming import alerts as al

FIRING, RESOLVED = "firing", "resolved"
EVENT = "from_s long, to_s long, windows long, event string"


class _Runs(StatefulProcessor):
    """Runs of windows of one key. ``names`` are the key's columns; rows bring ``start_s, step_s, length_s, need_s`` and ``hit``.

    ``start_s`` is a window's start, the next one starts ``step_s`` and this one closes ``length_s`` later. A run fires
    once ``to_s - from_s >= need_s``.
    """

    def __init__(self, names: Sequence[str]):
        self.names = list(names)

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start long, last long, windows long, fired boolean, step long, size long, need long, timer long")

    def close(self) -> None:
        pass

    @staticmethod
    def _ordered(rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """The windows of a batch by time; a batch of timers alone has none."""
        found = [w for pdf in rows if len(pdf) for w in zip(*(pdf[c].tolist() for c in ("start_s", "step_s", "length_s", "need_s", "hit")))]
        return sorted(found)

    def _out(self, key: tuple, events: list[tuple]) -> pd.DataFrame:
        rows = [(*key, *e) for e in events]
        return pd.DataFrame(rows, columns=[*self.names, "from_s", "to_s", "windows", "event"])

    def _keep(self, run: tuple, at_s: int) -> None:
        """Store the run and move the key's one timer."""
        at = at_s * 1000
        if run[7] != at:
            if run[7]:
                self.handle.deleteTimer(run[7])
            self.handle.registerTimer(at)
        self.run.update((*run[:7], at))


class HeldRuns(_Runs):
    """Every row is a breached window."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run = self.run.get() if self.run.exists() else None
        events: list[tuple] = []
        for s, step, size, need, _ in self._ordered(rows):
            if run is not None and run[2] and s == run[1] + step:
                run = (run[0], s, run[2] + 1, *run[3:])
            else:
                if run is not None and run[3]:
                    events.append((*run[:3], RESOLVED))
                run = (s, s, 1, False, step, size, need, run[7] if run is not None else 0)
            if not run[3] and s - run[0] >= need:
                run = (*run[:3], True, *run[4:])
                events.append((*run[:3], FIRING))
        if run is not None:
            # the window after the last one closes then
            self._keep(run, run[1] + run[4] + run[5])
        yield self._out(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = self.run.get()
        self.run.clear()
        yield self._out(key, [(*run[:3], RESOLVED)] if run[3] else [])


class SilentRuns(_Runs):
    """Rows are windows with something in them (``hit`` false) or the start of what is expected (``hit`` true).

    The run is the windows since; ``last`` is the last window before it while it has none.
    """

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run = self.run.get() if self.run.exists() else None
        events: list[tuple] = []
        for s, step, size, need, silent in self._ordered(rows):
            if run is None:
                run = (s if silent else s + step, 0, 0, False, step, size, need, 0)
            if silent:
                continue
            if s >= run[0]:
                # all windows from the run's start to this one were silent
                n = (s - run[0]) // step
                if n and not run[3] and self._fires(run) <= s + size - step:
                    run = self._firing(run, events)
                if run[3]:
                    events.append((run[0], s - step, n, RESOLVED))
                run = (s + step, 0, 0, False, step, size, need, run[7])
        if run is not None and not run[3]:
            self._keep(run, self._fires(run))
        elif run is not None:
            self.run.update(run)
        yield self._out(key, events)

    def _fires(self, run: tuple) -> int:
        """When the last silent window that it takes closes."""
        _, _, _, _, step, size, need, _ = run
        return run[0] + max(-(-need // step), 0) * step + size

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events: list[tuple] = []
        run = self._firing(self.run.get(), events)
        self.run.update((*run[:7], 0))
        yield self._out(key, events)

    def _firing(self, run: tuple, events: list[tuple]) -> tuple:
        """The run up to the window that makes it long enough."""
        last = self._fires(run) - run[5]
        run = (run[0], last, (last - run[0]) // run[4] + 1, True, *run[4:])
        events.append((*run[:3], FIRING))
        return run


def _machine(windows: DataFrame, keys: Sequence[str], processor) -> DataFrame:
    schema = StructType([*[StructField(k, windows.schema[k].dataType) for k in keys], *StructType.fromDDL(EVENT).fields])
    return windows.groupBy(*keys).transformWithStateInPandas(processor(keys), schema, "append", "eventTime")


def _closed(windows: DataFrame, start: Column, keys: Sequence[str], step: Column, size: Column, need: Column, hit: Column) -> DataFrame:
    """What the machines read, with the window's time as the only event time. Their columns begin with letters, as pandas' row tuples want."""
    return windows.select(
        *keys, F.window_time("window").alias("closed_at"), F.unix_seconds(start).alias("start_s"),
        *[c.cast("long").alias(n) for c, n in ((step, "step_s"), (size, "length_s"), (need, "need_s"))], hit.alias("hit"),
    )


def held_events(windows: DataFrame, breached: Column, keys: Sequence[str], step_seconds: int, hold_seconds: int, size_seconds: int | None = None) -> DataFrame:
    """``(keys, from_s, to_s, windows, event)`` on a stream of closed windows with their ``window`` column.

    ``firing`` once a run of breached windows has lasted ``hold_seconds`` beyond its first, ``resolved`` with
    the whole run when it ends. The resolved ones are what ``alerts.held`` finds in a batch.
    """
    one = "every_row"
    hits = windows.where(breached)
    named = list(keys) or [one]
    hits = hits if keys else hits.withColumn(one, F.lit(1))
    size = size_seconds or step_seconds
    rows = _closed(hits, F.col("window.start"), named, F.lit(step_seconds), F.lit(size), F.lit(hold_seconds), F.lit(True))
    out = _machine(rows, named, HeldRuns)
    return out if keys else out.drop(one)


def announced(metrics: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics with the instances that are expected to report: ``expected`` has ``(ts, rule, keys)``."""
    return metrics.select("ts", *keys, "metric", "value", F.lit(None).cast("string").alias("expects")).unionByName(
        expected.select("ts", *keys, F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), F.col("rule").alias("expects"))
    )


def metric_events(metrics: DataFrame, keys: Sequence[str], rules: Sequence[tuple] = ALERT_RULES) -> DataFrame:
    """``(keys, rule, severity, from_s, to_s, windows, event)`` of every rule on a stream of ``(ts, metric, value, keys)``.

    One aggregate for each window size of the rules. A column ``expects`` (see ``announced``) names a
    rule in rows without a metric: from then on the instance must be heard of, so one that never reports fires.
    """
    spark, keys = metrics.sparkSession, list(keys)
    announced_rule = F.concat(F.lit("rule "), F.col("expects")) if "expects" in metrics.columns else F.lit(None).cast("string")
    # never null, so that no filter on it goes below the watermark
    rows = al.watermarked(metrics, "ts").withColumn("_key", F.coalesce(F.col("metric"), announced_rule, F.lit("")))
    names = [*keys, "rule", "severity"]
    held = silent = None
    for size in sorted({r[2] for r in rules}):
        sized = [r for r in rules if r[2] == size]
        table = al.alert_rules(spark, sized)
        table = table.withColumn("_key", F.explode(F.array("metric", F.concat(F.lit("rule "), "rule")))).drop("metric")
        win = F.window("ts", f"{size} seconds")
        rule = ["rule", "severity", "statistic", "comparison", "bound", "size_s", "hold_s"]
        agg = rows.join(F.broadcast(table), "_key").groupBy(win.alias("window"), *keys, *rule).agg(*al.rule_aggregates(F.col("metric").isNotNull()))
        need, step = F.greatest(F.col("hold_s") - F.col("size_s"), F.lit(0)), F.col("size_s")
        loud = agg.where(~al.fires_on_silence() & (F.col("_count") > 0) & al.rule_breached())
        loud = _closed(loud, F.col("window.start"), names, step, step, need, F.lit(True))
        held = loud if held is None else held.unionByName(loud)
        if any(al.is_silence_rule(r) for r in sized):
            heard = _closed(agg.where(al.fires_on_silence()), F.col("window.start"), names, step, step, need, F.col("_count") == 0)
            silent = heard if silent is None else silent.unionByName(heard)
    out = _machine(held, names, HeldRuns)
    return out if silent is None else out.unionByName(_machine(silent, names, SilentRuns))
