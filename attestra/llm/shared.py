"""Shared-folder intermediates, Arrow helpers and the word rules that several operators use."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: [\x20\x09-\x0D], the only characters that separate words or are stripped from lines.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session, as in tests, may name none and gets
    a temporary one; on a cluster that would be a folder of one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    if not getattr(spark.sparkContext, "_settled_go_at_exit", False):  # the folder in it that is this application's own
        own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
        own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(own)
        spark.sparkContext._settled_go_at_exit = True
    return path.rstrip("/")


class Scratch:
    """A folder of intermediate tables inside the shared folder. Nothing that a returned DataFrame still reads is kept
    here: such results are `settled` with checkpoint(), whose files go when the application ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def write_bucketed(self, df: DataFrame, name: str, buckets: int, key: str, partition_by: str) -> DataFrame:
        """A table whose rows of one key lie in one bucket: work by that key needs no shuffle of them."""
        table = f"{name}_{uuid.uuid4().hex}"
        self.tables.append(table)
        (
            df.write.partitionBy(partition_by).bucketBy(buckets, key)
            .option("path", f"{self.path}/{table}").option("compression", "zstd").saveAsTable(table)
        )
        return self.spark.table(table)

    def remove(self, name: str = "") -> None:
        while self.tables and not name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: later stages don't depend on this executor or on earlier shuffles."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Ids (of 8 or 16 bytes) that may be sent to every task.
MOST_SENT = 1_000_000


def sent_if_few(ids: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """ids to join texts with: broadcast if they are counted to be at most `most`, so that the texts need not move; beyond
    that they are joined by shuffle."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


#: Texts that go to a worker in one Arrow batch.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """From now on the session sends at most BATCH_ROWS rows in an Arrow batch (Spark's default is 10,000). Executor and worker each
    hold a whole batch beside the heap, so that rows of long texts weigh there. It is set for good, as a lazy result runs later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def in_slices(batches, rows: int = 1000):
    """The record batches in slices, so that a worker makes Python objects of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def in_blocks(batches, chars: int = 1_000_000):
    """(slice of a record batch, its texts, which stand last), with so many characters at most or one text."""
    for batch in in_slices(batches):
        texts, at = texts_of(batch.columns[-1]), 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= chars:
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def ascii_lower(c):
    """A-Z lower-cased, other characters as they are. lower() does just that for texts of ASCII characters alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
