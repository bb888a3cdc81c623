"""Tables and files that later stages read again, kept in the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from tallyscope.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, so lost executors cost no recompute."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder for files that tasks write themselves."""
    return scratch_path(spark, label)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain local path."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def write_once(folder: str, name: str, suffix: str = "") -> tuple[pafs.NativeFile, str]:
    """A stream to a file whose name no other task attempt uses, and the file's URI.

    A repeated attempt writes another file; only the files named in the rows that Spark
    commits count.
    """
    uri = f"{folder}/{name}-{uuid.uuid4().hex}{suffix}"
    system, path = opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None), uri


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or with underscores added until no column has it."""
    while wanted.lower() in {c.lower() for c in columns}:
        wanted += "_"
    return wanted
