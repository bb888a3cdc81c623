"""Shared folder: never a local one on a cluster; scratch tables have an end."""

import os
from types import SimpleNamespace

import pytest

from tallyscope import session


def test_cluster_without_shared_folder_is_an_error():
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)


def test_only_one_process_counts_as_local():
    assert session.one_process("local") and session.one_process("local[8]") and session.one_process("local[*]")
    assert not session.one_process("local-cluster[3,2,1024]") and not session.one_process("yarn")


def test_scratch_is_cleared(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.exists(local)
    session.clear_scratch(spark)
    assert not os.path.exists(local)
