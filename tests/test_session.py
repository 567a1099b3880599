"""Checkpoint folders and scratch tables."""

import os
import types

import pytest

from servicelens import session


def fake(master, configured=None):
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d=None: configured))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake(master))
    assert session.ensure_checkpoint_dir(fake(master, "hdfs://shared")) == "hdfs://shared"


def test_local_sessions_may_go_without(tmp_dir):
    assert session.ensure_checkpoint_dir(fake("local[4]"), tmp_dir) == tmp_dir


def test_scratch_folders_are_released(spark):
    path = session.scratch_folder(spark, "x")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local) and session.release_scratch(spark) >= 1 and not os.path.exists(local)
