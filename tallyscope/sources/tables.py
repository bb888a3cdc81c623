"""Typed append and read of the audit tables, integrity checks, parameterised SQL."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.schemas import DEFAULTS, TABLES


def conformed(df: DataFrame, table: str) -> DataFrame:
    """Rows in the table's schema: ids and times filled, defaults applied, nested parts as JSON."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in TABLES[table].fields:
        default = DEFAULTS[table].get(f.name)
        if f.name in have:
            col = F.col(f.name)
            if isinstance(have[f.name], (T.StructType, T.ArrayType, T.MapType)):
                col = F.to_json(col)
            col = col.cast(f.dataType)
        else:
            col = F.lit(None).cast(f.dataType)
        if default is not None:
            col = F.coalesce(col, F.lit(default).cast(f.dataType))
        elif f.name == "id":
            col = F.coalesce(col, F.uuid())
        elif f.name in ("created_at", "updated_at", "upload_timestamp", "extraction_timestamp", "analysis_timestamp", "checked_at"):
            col = F.coalesce(col, F.current_timestamp())
        out.append(col.alias(f.name))
    return df.select(*out)


def append(df: DataFrame, table: str, path: str, partition_by: str | None = None) -> int:
    """Append to the table and return the rows written, counted during the write."""
    seen = Observation()
    rows = conformed(df, table).observe(seen, F.count(F.lit(1)).alias("n"))
    writer = rows.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return seen.get["n"]


def read(spark: SparkSession, table: str, path: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(path)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (Spark enforces no primary key)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose reference has no parent row."""
    ids = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(ids, child_key, "left_anti")


@dataclass
class QueryResult:
    data: DataFrame
    columns: list[str]
    query: str
    row_count: int | None = None
    execution_time: float | None = None

    def write(self, path: str) -> "QueryResult":
        """Write the rows once; the count and time come from that run."""
        seen, start = Observation(), time.monotonic()
        self.data.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        self.row_count, self.execution_time = seen.get["n"], time.monotonic() - start
        return self


def run_sql(spark: SparkSession, text: str, args: dict | list | None = None) -> QueryResult:
    """SQL with bound parameters; nothing runs until the result is used."""
    data = spark.sql(text, args=args)
    return QueryResult(data, data.columns, text)
