"""Session factory, shared folder and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "tallyscope", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time, adaptive execution and Arrow transfer.

    ``conf`` keys use ``__`` for ``.`` (``spark__sql__shuffle__partitions="8"``).
    On a cluster leave ``master`` unset and let the submitter choose it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Without the setting, a session in one process (``local[...]``: tests, laptops) gets a local
    folder. Elsewhere executors would write to disks of their own, so that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        if not configured and not one_process(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tallyscope-"))
        current = context.getCheckpointDir()
    return configured or current


def one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tallyscope-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path in the application's scratch folder for one written table or stream."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _opened(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it exists."""
    place, system = _opened(spark, path)
    system.delete(place, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none if it does not exist."""
    place, system = _opened(spark, path)
    return [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; call it when their results have been read."""
    remove(spark, scratch_dir(spark))


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in shared storage, so lost executors cost no recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
