"""Running the operators as Structured Streaming queries."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.constants import RETENTION_DAYS
from tallyscope.operators.ordered import top_n
from tallyscope.schemas import UPDATES
from tallyscope.session import names_in, remove, scratch_path
from tallyscope.streaming.alerts import watermarked


#: No event is later; pandas has no times after 2262.
END = datetime(2200, 1, 1, tzinfo=timezone.utc)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def update_stream(spark: SparkSession, path: str) -> DataFrame:
    """Audit updates from JSON files, the payload opened as a string map."""
    raw = read_stream(spark, path, UPDATES, "json")
    return raw.withColumn("payload", F.from_json("payload", "map<string,string>"))


@contextmanager
def kept_in_rocksdb(spark: SparkSession):
    """State machines with timers need Spark's RocksDB state store; a query takes the setting when it starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_available(stream: DataFrame, label: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process all available input into a parquet table in the shared folder and read it back.

    Checkpoint and output share one fresh folder, so a lost run can be resumed.
    """
    spark = stream.sparkSession
    base = path or scratch_path(spark, label)
    with kept_in_rocksdb(spark):
        query = (
            stream.writeStream.outputMode(mode)
            .format("parquet")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{base}/rows")
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_so_far(read: Callable[[], DataFrame], ts: str, build: Callable[[DataFrame], DataFrame], label: str, path: str, delay: str = "10 minutes") -> DataFrame:
    """Process what has come, beside a source that only ``run_to_end`` writes to; goes on where the last run stopped."""
    source = read()
    spark, schema = source.sparkSession, source.schema
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/end")
    both = source.unionByName(read_stream(spark, f"{path}/end", schema))
    return run_available(build(both.withWatermark(ts, delay)), label, path=f"{path}/out")


def run_to_end(read: Callable[[], DataFrame], ts: str, build: Callable[[DataFrame], DataFrame], label: str, delay: str = "10 minutes",
               until: datetime = END, path: str | None = None) -> DataFrame:
    """Run a finished stream to its very end: what waits for a later watermark comes out, too.

    Only newer rows move a watermark, so a stream that has ended keeps its last ``delay`` to itself. Here
    a second source stands beside ``read()``. It is empty until all input is done; then it gets one row of
    nulls whose time puts the watermark to ``until``, and the same query goes on from its checkpoint.
    ``build`` must let that row pass up to its windows (count with a condition, or filter with ``or_end``);
    the row's own window never closes.
    """
    spark, schema = read().sparkSession, read().schema
    path = path or scratch_path(spark, label)
    run_so_far(read, ts, build, label, path, delay)
    at = F.lit(until).cast("timestamp") + F.expr(f"INTERVAL {delay}")
    last = spark.range(1).select(*[(at if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
    last.write.mode("append").parquet(f"{path}/end")
    return run_so_far(read, ts, build, label, path, delay)


def or_end(condition: Column, ts: str) -> Column:
    """A filter for ``run_to_end``: what meets the condition, and the row of nulls that ends the stream.

    It names the event time, so Spark leaves it above the watermark.
    """
    return F.coalesce(condition, F.lit(True)) & F.col(ts).isNotNull()


def run_complete(stream: DataFrame, label: str) -> DataFrame:
    """Keep an aggregate of a stream as a table: every batch writes the whole result anew, the last one is read back."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows")

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def audit_trail(stream: DataFrame, ts: str, path: str, checkpoint: str, flags: dict[str, Column] | None = None):
    """Append-only trail partitioned by day, so retention drops whole partitions.

    ``flags`` are compliance flags by name; ``compliance_critical`` says whether one is set, which
    retention reads.
    """
    rows = stream.withColumn("day", F.to_date(ts)).withColumn("expires", F.date_add(F.to_date(ts), RETENTION_DAYS))
    any_flag = F.lit(False)
    for name, condition in (flags or {}).items():
        rows = rows.withColumn(name, F.coalesce(condition, F.lit(False)))
        any_flag = any_flag | F.col(name)
    rows = rows.withColumn("compliance_critical", any_flag)
    return (
        rows.writeStream.outputMode("append").format("parquet").partitionBy("day").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def newest(stream: DataFrame, keys: list[str], time: str, key: str, n: int, path: str) -> DataFrame:
    """Keep the newest ``n`` rows per key in a table: each batch merges its own newest with the last table.

    The table holds ``n`` rows per key. Batch ids are consecutive, also after a restart, so
    batch i reads version i - 1 and writes version i; a repeated batch repeats its own write.
    """
    spark = stream.sparkSession
    order = [F.col(time).desc(), F.col(key).desc()]

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = top_n(batch, keys, order, n, "_r").drop("_r")
        if batch_id > 0:
            rows = top_n(rows.unionByName(spark.read.parquet(f"{path}/v{batch_id - 1}")), keys, order, n, "_r").drop("_r")
        rows.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        if batch_id > 1:
            remove(spark, f"{path}/v{batch_id - 2}")  # a repeated batch reads no older one

    run_batches(stream, f"{path}/checkpoint", merge)
    versions = [int(x[1:]) for x in names_in(spark, path) if x[:1] == "v" and x[1:].isdigit()]
    return spark.read.parquet(f"{path}/v{max(versions)}") if versions else spark.createDataFrame([], stream.schema)


def feedback_join(predictions: DataFrame, feedback: DataFrame, key: str, within: str = "1 hour") -> DataFrame:
    """Predictions with the feedback that arrives up to ``within`` after them; both sides watermarked."""
    p = predictions.alias("p") if not predictions.isStreaming else predictions.withWatermark("predicted_at", "10 minutes").alias("p")
    f = feedback.alias("f") if not feedback.isStreaming else feedback.withWatermark("feedback_at", "10 minutes").alias("f")
    on = (
        (F.col(f"p.{key}") == F.col(f"f.{key}"))
        & (F.col("f.feedback_at") >= F.col("p.predicted_at"))
        & (F.col("f.feedback_at") <= F.col("p.predicted_at") + F.expr(f"INTERVAL {within}"))
    )
    return p.join(f, on).select(f"p.{key}", "predicted_at", "is_anomaly", "confidence", "feedback_at", "human_feedback")


def trailing_bursts(stream: DataFrame, user: str, ts: str, least: int = 10, seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Exact trailing-window failure count on a stream, one output row per event that reaches ``least``.

    An event is judged once the watermark has passed it, so rows that come up to ``delay`` late
    and out of order are counted; later ones are dropped. State is a user's times that wait and
    those of the last ``seconds`` before the watermark, and goes when both are empty.
    """
    span = seconds * 1_000_000
    rows = watermarked(stream, ts, delay).select(F.col(user).cast("long").alias("user"), F.col(ts).alias("at"), F.unix_micros(ts).alias("us"))
    schema = "user long, us long, recent long"

    def update(key, batches, state):
        kept, done = (list(state.get[0]), state.get[1]) if state.exists else ([], -(1 << 62))
        fresh = [] if state.hasTimedOut else [int(u) for pdf in batches for u in pdf["us"]]
        times, passed = sorted(kept + fresh), state.getCurrentWatermarkMs() * 1000
        out = []
        for u in times[bisect_right(times, done) : bisect_right(times, passed)]:
            recent = bisect_right(times, u) - bisect_right(times, u - span)
            if recent >= least:
                out.append((key[0], u, recent))
        waiting = times[bisect_right(times, passed) :]
        times = times[bisect_right(times, passed - span) :]
        if times:
            state.update((times, max(done, passed)))
            # fires once the watermark reaches the next event to judge, or lets go of the last one kept
            at = -(-waiting[0] // 1000) - 1 if waiting else (times[-1] + span) // 1000 + 1
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user", "us", "recent"])

    return rows.groupBy("user").applyInPandasWithState(update, schema, "times array<long>, done long", "append", "EventTimeTimeout")
