"""Scratch folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from .errors import ConfigurationError


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared checkpoint folder, removed by ``remove_path`` or when the driver's JVM ends.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one
    process (tests) a temporary folder takes its place; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ConfigurationError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
            base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/docloom/{tag}-{uuid.uuid4().hex}"
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes what was written to a path that nothing reads any more."""
    files, where = _files(spark, path)
    files.delete(where, True)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
