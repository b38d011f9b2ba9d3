"""Folders that driver and executors share, for tables that an operation writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session, as in tests, may name none."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def working_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """A new folder's path; the folder goes at the end, also after an error."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """The rows by themselves, for results whose folder goes."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
