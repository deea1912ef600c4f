"""Scratch folders: shared on a cluster, temporary in one process, removable."""

import os
from types import SimpleNamespace

import pytest

from docloom.errors import ConfigurationError
from docloom.scratch import remove_path, scratch_path


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_a_cluster_needs_a_shared_folder(master):
    spark = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(ConfigurationError, match="spark.checkpoint.dir"):
        scratch_path(spark, "t")


def test_tables_can_be_removed(spark):
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert spark.read.parquet(path).count() == 3 and os.path.isdir(local)
    remove_path(spark, path)
    assert not os.path.exists(local) and scratch_path(spark, "t") != path
