"""File scans: discovery with whitelist and size cap, CSV, text and JSON with encoding fallback."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.constants import FILE_EXTENSIONS, MAX_FILE_BYTES


def discover(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, length, extension, reason): ``reason`` is null for accepted files. Content is not read.

    Files above ``max_bytes`` (50 MB unless given) are rejected with a reason.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    reason = F.when(~ext.isin(FILE_EXTENSIONS), F.concat(F.lit("unsupported file format: "), ext)).when(
        F.col("length") > max_bytes, "file too large"
    )
    return files.select("path", "length", ext.alias("extension"), reason.alias("reason"))


def accepted(found: DataFrame) -> DataFrame:
    return found.where(F.col("reason").isNull())


def quarantined(found: DataFrame) -> DataFrame:
    return found.where(F.col("reason").isNotNull())


def read_text(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text): UTF-8, or Latin-1 for a file that is not valid UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))


def _not_utf8(spark: SparkSession, path: str, glob: str) -> set[str]:
    """Names of the files with a line that is not valid UTF-8 (line reader: no file is held whole)."""
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    bad = lines.where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("f")).distinct()
    return {r["f"] for r in bad.collect()}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, glob: str = "*.csv", multiline: bool = False) -> DataFrame:
    """CSV with header. A file that is not valid UTF-8 is read as Latin-1, which takes every byte; the others are not.

    ``multiline`` takes line breaks inside quotes, at the price of one task per file. Pass
    ``schema`` in production; without it the types are inferred from a full pass.
    """

    def read(paths, encoding: str, kind: T.StructType | None) -> DataFrame:
        reader = spark.read.option("header", "true").option("encoding", encoding).option("pathGlobFilter", glob)
        reader = reader.option("multiLine", multiline).option("escape", '"')
        return (reader.schema(kind) if kind else reader.option("inferSchema", "true")).csv(paths)

    bad = _not_utf8(spark, path, glob)
    if not bad:
        return read(path, "UTF-8", schema)
    kind = schema or read(path, "ISO-8859-1", None).schema
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("_metadata.file_path").collect()
    good = sorted({r["file_path"] for r in found} - bad)
    latin = read(sorted(bad), "ISO-8859-1", kind)
    return read(good, "UTF-8", kind).unionByName(latin) if good else latin


@F.pandas_udf(T.StringType())
def _indented(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return json.dumps(json.loads(text), indent=2)
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


def read_json_text(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, text): each JSON document with two-space indents, key order kept; null if not JSON.

    Spark's own JSON values reorder keys, so this goes through an Arrow function.
    """
    return read_text(spark, path, glob).select("path", _indented("text").alias("text"))


def profile(df: DataFrame, order: list[str], sample: int = 10) -> tuple[DataFrame, DataFrame]:
    """(statistics per numeric column, first rows): one aggregate pass and one top-n."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    x = {c: F.col(c).cast("double") for c in numeric}
    wide = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).alias(f"s_{c}")
            for c, v in x.items()
        ],
    )
    stats = wide.select("row_count", F.inline(F.array(*[F.col(f"s_{c}") for c in numeric])))
    return stats, df.orderBy(*order).limit(sample)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_feedback(df: DataFrame, path: str) -> None:
    """Append-only feedback log as JSON lines."""
    df.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)
