"""Layouts of the cases that single lookups and single pages can prune.

The queue lies by status and in chunks of (created_at, id) order, in row groups of GROUP rows, with a table of bounds beside
it: one row for each run of GROUP rows, its place in the chunk. A page looks up in the bounds which places hold its rows and
reads these alone: the chunk is a partition, other row groups are left out by the statistics of the place.

Trails lie in buckets by the hash of the case, in order of (case_id, seq), with Bloom filters on case_id. A lookup reads
one bucket's file and of it the row groups whose statistics and filter may hold the case.

Defined cases: equal times stand by id; a cursor after the last case gives an empty page; a status that no case has is an empty
queue; a row with a null status, time or id belongs to no page; trails of a null case can't be looked up; empty tables give empty
stores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.operators.queue import MOST_ROWS, ROWS, queue_page

#: Rows of a row group and of a chunk, which is one file.
GROUP, CHUNK = 1_000, 500_000
_WRITE = {"parquet.block.row.count.limit": str(GROUP), "compression": "zstd"}


def write_queue(cases: DataFrame, path: str, group: int = GROUP, chunk: int = CHUNK) -> None:
    """cases (id, created_at, status, ...) as a queue store at path."""
    spark = cases.sparkSession
    rows = cases.where("status is not null and created_at is not null and id is not null")
    n = rows.count()
    ranged = rows.repartitionByRange(max(1, -(-n // chunk)), "status", "created_at", "id").withColumn("chunk", F.spark_partition_id())
    ordered = ranged.sortWithinPartitions("status", "chunk", "created_at", "id")  # the writer's own order first, else it sorts again
    placed = ordered.withColumn("place", F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / group).cast("int"))
    if n:
        placed.write.options(**_WRITE | {"parquet.block.row.count.limit": str(group)}).partitionBy("status", "chunk").parquet(f"{path}/cases")
    else:
        placed.write.parquet(f"{path}/cases")
    bounds = _queue(spark, path, cases).groupBy("status", "chunk", "place").agg(F.max(F.struct("created_at", "id")).alias("last"), F.count("*").alias("n"))
    sorted_bounds = bounds.select("status", "chunk", "place", "last.created_at", "last.id", "n").repartitionByRange("status", "created_at", "id")
    sorted_bounds.sortWithinPartitions("status", "created_at", "id").write.options(**_WRITE).parquet(f"{path}/bounds")


def _queue(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    rest = [f for f in like.schema.fields if f.name not in ("status", "chunk", "place")] + [T.StructField("place", T.IntegerType())]
    schema = T.StructType([*rest, T.StructField("status", T.StringType()), T.StructField("chunk", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/cases")


def _after(at: Column, key: Column) -> Column:
    """The keyset condition, written out, as only that form reaches the reader."""
    return (F.col("created_at") >= at) & ((F.col("created_at") > at) | (F.col("id") > key))


def stored_page(spark: SparkSession, path: str, limit: int = ROWS, after: tuple | None = None, status: str = "in_review") -> DataFrame:
    """queue_page from the store: of the bounds as many groups after the key as hold `limit` + 1 rows, then these groups alone."""
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be 1 to {MOST_ROWS}")
    cases, bounds = spark.read.parquet(f"{path}/cases"), spark.read.parquet(f"{path}/bounds").where(F.col("status") == status)
    if after is not None:
        after = tuple(x if isinstance(x, Column) else F.lit(x) for x in after)
        bounds = bounds.where(_after(*after))
    groups, several = [], 4
    while True:  # the first group may hold few rows after the key, and the last of a chunk few at all
        found = bounds.orderBy("created_at", "id").limit(several).collect()
        groups, rows = [], 0
        for i, g in enumerate(found):
            groups.append(g)
            rows += g["n"] if i or after is None else 1  # the first holds one row after the key at least
            if rows > limit:
                break
        if rows > limit or len(found) < several:
            break
        several *= 4
    if not groups:
        return queue_page(cases.where(F.lit(False)), limit, None, status).drop("chunk", "place")
    places = F.lit(False)
    for c in sorted({g["chunk"] for g in groups}):
        own = [g["place"] for g in groups if g["chunk"] == c]
        places = places | ((F.col("chunk") == c) & F.col("place").between(min(own), max(own)))
    return queue_page(cases.where(places), limit, after, status).drop("chunk", "place")


# --- trails --------------------------------------------------------------------------------------------------------


def _bucket(case_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(case_id.cast("string")), F.lit(buckets)).cast("int")


def write_trails(events: DataFrame, path: str, buckets: int = 64, group: int = GROUP) -> None:
    """events (seq, case_id, ...) as a trail store at path: one file a bucket. The number of buckets is part of the path."""
    rows = events.withColumn("bucket", _bucket(F.col("case_id"), buckets))
    options = {
        "parquet.bloom.filter.enabled#case_id": "true", "parquet.bloom.filter.expected.ndv#case_id": str(group),
        "parquet.enable.dictionary#case_id": "false", "parquet.block.row.count.limit": str(group), "compression": "zstd",
    }
    ordered = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "case_id", "seq")
    ordered.write.options(**options).partitionBy("bucket").parquet(f"{path}/buckets={buckets}")


def read_trails(spark: SparkSession, path: str) -> DataFrame:
    """All events with bucket and buckets."""
    return spark.read.option("basePath", path).parquet(path)


def _of(trails: DataFrame, case_id) -> DataFrame:
    buckets = trails.select("buckets").limit(1).first()
    if buckets is None:
        raise LookupError(f"no case {case_id}")
    bucket = trails.sparkSession.range(1).select(_bucket(F.lit(case_id), buckets["buckets"]).alias("b")).first()["b"]
    return trails.where((F.col("bucket") == bucket) & (F.col("case_id") == F.lit(case_id))).drop("bucket", "buckets")


def stored_trail(spark: SparkSession, path: str, case_id) -> DataFrame:
    """A case's events in order; an unknown case is an error."""
    found = _of(read_trails(spark, path), case_id)
    if found.isEmpty():
        raise LookupError(f"no case {case_id}")
    return found.orderBy("seq")


def stored_case(spark: SparkSession, path: str, case_id) -> DataFrame:
    """A case's last event; an unknown case is an error."""
    found = stored_trail(spark, path, case_id)
    return found.orderBy(F.desc("seq")).limit(1)
