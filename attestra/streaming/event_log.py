"""An append-only event log of commits.

A batch of events is written to a folder of its own and becomes part of the log by one commit file, which is put in place
only if no other has its number. Who comes second with a number looks at what the other added and tries the next, so every
commit was judged against all before it: a seq that the log holds already, or that the batch holds twice, refuses the whole
batch. A batch with a name is added once, however often it is sent: a stream that failed after the commit sends it again.
Readers see the folders of commits alone; what a writer that failed left behind is never read.

The rename that puts a commit in place must refuse an existing target in one step, as HDFS does; a local file system looks
first and renames then, which is enough for one machine's tests.

Defined cases: an empty batch commits nothing unless it has a name; null seqs are refused; a log without commits is empty.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMIT = "folder string, batch string, least long, most long, n long"


class EventLog:
    """The log at path, of events of one schema that has seq."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType) -> None:
        self.spark, self.path = spark, path
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def commits(self) -> list[dict]:
        """What each commit says, in order. One small row for each batch."""
        if not self._files.exists(self._at("commits")):
            return []
        rows = self.spark.read.schema(_COMMIT).json(f"{self.path}/commits").select("*", F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long").alias("number"))
        return [r.asDict() for r in rows.orderBy("number").collect()]

    def read(self) -> DataFrame:
        """All events; a seq stands once."""
        folders = [f"{self.path}/{c['folder']}" for c in self.commits() if c["n"]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def append(self, events: DataFrame, batch: str | None = None) -> bool:
        """False if a batch of this name is there already."""
        columns = [f.name for f in self.schema.fields]
        return self._add(lambda first: self._write(events.select(*columns)), batch)

    def append_numbered(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Like append, for rows without seq: they are numbered on from the log's last one, in their partitions' order."""
        staged = self._write(rows)
        try:
            return self._add(lambda first: self._write(self._numbered(self.spark.read.schema(rows.schema).parquet(f"{self.path}/{staged}"), first)), batch)
        finally:
            self._files.delete(self._at(staged), True)

    def _numbered(self, rows: DataFrame, first: int) -> DataFrame:
        """rows are a written table, so that their partitions are the same at each reading; their sizes come to the driver."""
        sizes = {r["p"]: r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()}
        before, total = {}, first
        for p in sorted(sizes):
            before[p], total = total, total + sizes[p]
        if not before:
            return rows.withColumn("seq", F.lit(0).cast("long")).select(*self.schema.names)
        start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.spark_partition_id())
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        return rows.withColumn("seq", (start + place).cast("long")).select(*self.schema.names)

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _add(self, write, batch: str | None) -> bool:
        while True:
            known = self.commits()
            if batch is not None and any(c["batch"] == batch for c in known):
                return False
            folder = write(1 + max((c["most"] for c in known if c["n"]), default=-1))
            try:
                says = self._judged(folder, batch, known)
            except BaseException:
                self._files.delete(self._at(folder), True)
                raise
            # An error from here on leaves the folder: the commit may stand.
            if says is None or self._commit(1 + max((c["number"] for c in known), default=-1), says):
                return True
            self._files.delete(self._at(folder), True)  # another writer was first: number and judge again

    def _judged(self, folder: str, batch: str | None, known: list[dict]) -> dict | None:
        """What the commit says; None if there is nothing to commit."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").select("seq")
        got = rows.agg(F.count("*").alias("n"), F.count("seq").alias("some"), F.count_distinct("seq").alias("distinct"), F.min("seq").alias("least"), F.max("seq").alias("most")).first()
        if not got["n"] and batch is None:
            self._files.delete(self._at(folder), True)
            return None
        if got["some"] < got["n"]:
            raise ValueError("the log is append-only: an event has no seq")
        doubled = got["distinct"] < got["n"]
        near = [c for c in known if c["n"] and got["n"] and c["least"] <= got["most"] and got["least"] <= c["most"]]
        if near and not doubled:  # only commits whose seqs overlap are read
            there = self.spark.read.schema("seq long").parquet(*[f"{self.path}/{c['folder']}" for c in near])
            doubled = not rows.join(there, "seq", "left_semi").isEmpty()
        if doubled:
            raise ValueError("the log is append-only: an event with this seq exists")
        return {"folder": folder, "batch": batch, "least": got["least"], "most": got["most"], "n": got["n"]}

    def _commit(self, number: int, says: dict) -> bool:
        """False if the number is taken."""
        draft, place = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"commits/{number:020d}.json")
        self._files.mkdirs(self._at("commits"))
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(says).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.makeQualified(draft).toUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        try:
            context.rename(self._files.makeQualified(draft), self._files.makeQualified(place), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self._files.delete(draft, False)
        return True


def add_each_batch(log: EventLog, name: str):
    """For foreachBatch: each batch of the stream `name` is added once, as often as Spark sends it."""

    def add(events: DataFrame, number: int) -> None:
        log.append(events, f"{name}:{number}")

    return add
