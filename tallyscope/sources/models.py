"""Fitted models as tables: tree nodes, scaler rows, category dictionaries and metadata.

Dictionaries are versioned: a version is the digest of its entries, the metadata name the one that the
model was fitted with, and loading another one fails. A value that the dictionary lacks is coded -1,
like a null, so scoring other data never moves the code of a known category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.operators.features import codes


def scaler_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, std): population std, 1 where a feature is constant."""
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.coalesce(F.nullif(F.stddev_pop(F.col(c).cast("double")), F.lit(0.0)), F.lit(1.0)).alias("std"),
            ).alias(c)
            for c in features
        ]
    )
    return row.select(F.inline(F.array(*[F.col(c) for c in features])))


def apply_scaler(df: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale with stored statistics. The scaler has one row per feature, pivoted to one row."""
    wide = scaler.groupBy().agg(
        *[F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"_m_{c}") for c in features],
        *[F.max(F.when(F.col("feature") == c, F.col("std"))).alias(f"_s_{c}") for c in features],
    )
    out = df.crossJoin(F.broadcast(wide))
    for c in features:
        value = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        out = out.withColumn(c, (value - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
    return out.select(*df.columns)


def encoder_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value, code)``: the values of each column in sorted order from 0."""
    out = None
    for c in columns:
        part = codes(df.select(F.col(c).cast("string").alias("value")), "value").select(F.lit(c).alias("feature"), "value", F.col("_code").alias("code"))
        out = part if out is None else out.unionByName(part)
    return out


def encoder_version(encoders: DataFrame) -> str:
    """Digest of the entries in any order."""
    entry = F.xxhash64("feature", "value", "code").cast("decimal(38,0)")
    n, total = encoders.agg(F.count(F.lit(1)), F.coalesce(F.sum(entry), F.lit(0))).first()
    return f"{n}-{int(total) % 2**64:016x}"


def apply_encoders(df: DataFrame, encoders: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_code``; nulls and values that the dictionary lacks get -1."""
    for c in columns:
        known = encoders.where(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("code").alias(f"{c}_code"))
        df = df.join(known, F.col(c).cast("string") == F.col("_value"), "left").drop("_value").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return df


def save_model(path: str, nodes: DataFrame, scaler: DataFrame, features: Sequence[str], encoders: DataFrame | None = None, **meta: str) -> None:
    spark = nodes.sparkSession
    if encoders is not None:
        encoders.write.mode("overwrite").parquet(f"{path}/encoders")
        meta["encoders"] = encoder_version(spark.read.parquet(f"{path}/encoders"))
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    rows = [("features", ",".join(features)), *[(k, str(v)) for k, v in meta.items()]]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(nodes, scaler, metadata); the metadata table has a handful of rows."""
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/meta").collect()}
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/scaler"), meta


def load_encoders(spark: SparkSession, path: str) -> DataFrame:
    """The model's dictionary; an error if it is not the one that the model was fitted with."""
    encoders = spark.read.parquet(f"{path}/encoders")
    _, _, meta = load_model(spark, path)
    found = encoder_version(encoders)
    if found != meta.get("encoders"):
        raise ValueError(f"the model was fitted with dictionary {meta.get('encoders')}, not {found}")
    return encoders
