"""Line dedup over levelled sorted runs, in DataFrame operations alone.

Documents arrive in batches, largest doc_ids first. A run is a table of line keys, bucketed and sorted by key hash, so
that the merge join with it needs no shuffle of the run. Each batch merge-anti-joins the runs: keys that no run holds are
added with the batch's largest doc_id as their keeper; keys already there are added as counts only. When a level holds
`fanout` runs they are compacted into one run of the next level by full outer merge joins, two runs at a time: a run has
one row for each key, and so has their join. The last compaction, of all levels, gives each key's number of documents and
its keeper; lines of keys in `min_docs` documents or more go, except in the keeper. Buckets follow the number of lines.

Defined cases: a null or empty text is one empty line; rows with a null doc_id are returned whole and count for no key;
rows that repeat a doc_id are one document for counting and are each filtered; lines of a key inside its keeper all stay;
texts and lines of any length are read whole; an empty table gives an empty result. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared import SPACES, Scratch, ascii_lower, settled

KEY = ("_ld_h1", "_ld_h2")
HOT = 1000
#: Lines in a bucket of a run, about.
BUCKET_LINES = 4_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """The levelled runs. Columns of a run: the 128-bit key hash, n_docs, keeper (null in rows that only add counts)."""

    def __init__(self, scratch: Scratch, buckets: int, fanout: int = 2) -> None:
        self.scratch, self.buckets, self.fanout = scratch, buckets, fanout
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", f"{self.scratch.path}/{name}")
            .option("compression", "zstd")
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.scratch.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.remove(name)

    def tables(self) -> list[DataFrame]:
        return [self.scratch.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """batch: key hash, n_docs, keeper; one row per key."""
        fresh, seen = batch, None
        for run in self.tables():
            known = run.where(F.col("keeper").isNotNull()).select(*KEY)
            counted = batch.join(known, list(KEY), "left_semi")
            seen = counted if seen is None else seen.unionByName(counted)
            fresh = fresh.join(known, list(KEY), "left_anti")
        rows = fresh if seen is None else fresh.unionByName(seen.withColumn("keeper", F.lit(None).cast("long")))
        self._write(rows, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(self.levels[level], level + 1)
            self.levels[level] = []
            level += 1

    def _compact(self, names: list[str], level: int) -> None:
        self._write(_merged([self.scratch.spark.table(n) for n in names]), level)
        self._drop(names)

    def merged(self) -> DataFrame:
        """One row for each key of all runs."""
        return _merged(self.tables())

    def close(self) -> None:
        self._drop([n for level in self.levels for n in level])


def _merged(runs: list[DataFrame]) -> DataFrame:
    """The runs merged in turn. Two runs stand in the same buckets, so the join needs no shuffle of them; a union of theirs
    would be taken to be bucketed as well, which its partitions are not."""
    rows = runs[0]
    for run in runs[1:]:
        other = run.select(*KEY, F.col("n_docs").alias("_n"), F.col("keeper").alias("_k"))
        total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))
        rows = rows.join(other, list(KEY), "full_outer").select(*KEY, total.alias("n_docs"), F.greatest("keeper", "_k").alias("keeper"))
    return rows


def _dropped(lines: DataFrame, n_lines: int, common: DataFrame) -> DataFrame:
    """(_ld_id, _ld_of, _ld_at): the places of the lines that go. A key in over one of HOT lines is sent to all tasks, of
    which keys there are HOT at most, so that its lines need not meet; the others are joined by shuffle."""
    hot = F.col("n_docs") * HOT > n_lines
    frequent = F.broadcast(common.where(hot).select(*KEY, "keeper"))
    others = lines.join(frequent, list(KEY), "left_anti").join(common.where(~hot).select(*KEY, "keeper"), list(KEY))
    return (
        lines.join(frequent, list(KEY))
        .unionByName(others)
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("_ld_id"), F.col("of").alias("_ld_of"))
        .agg(F.array_sort(F.collect_set("pos")).alias("_ld_at"))
    )


def dedup_lines(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """docs (doc_id, text, ...) with kept_text, n_lines and n_dropped added."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    bounds = (
        docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10000).alias("at")).first()["at"]
        or []
    )
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + (F.col("doc_id") <= F.lit(bound)).cast("int")
    key = line_key(F.col("line"))
    lines = (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("of"), batch.alias("batch"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "of", "batch", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "of", "batch", "pos", F.xxhash64("key").alias(KEY[0]), F.xxhash64(F.lit("line"), "key").alias(KEY[1]))
    )
    runs = None
    try:
        lines = scratch.write(lines, "lines", partition_by="batch")
        n_lines = lines.count()
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_lines // (BUCKET_LINES * batches)))
        runs = LineRuns(scratch, buckets, fanout)
        for i in range(len(bounds) + 1):
            docs_of_key = lines.where(F.col("batch") == i).select("doc_id", *KEY).distinct()
            runs.add(docs_of_key.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")))
        common = scratch.write(runs.merged().where(F.col("n_docs") >= min_docs), "common")
        drops = settled(_dropped(lines, n_lines, common))
    finally:
        if runs is not None:
            runs.close()
        scratch.remove()
    # The input row goes along as one column, so that none of its names can clash with those used here. What stays is the
    # slices between dropped lines, which is linear in the number of lines.
    text = F.col("row.text")
    marked = docs.select(F.struct("*").alias("row")).join(
        drops, (F.col("row.doc_id") == F.col("_ld_id")) & (F.xxhash64(text) == F.col("_ld_of")), "left"
    ).withColumn("_ld_lines", lines_of(text))
    ends = F.concat(F.col("_ld_at"), F.array(F.size("_ld_lines")))
    start = lambda i: F.when(i == 0, 0).otherwise(F.element_at("_ld_at", F.greatest(i, F.lit(1))) + 1)
    kept = F.flatten(F.transform(ends, lambda end, i: F.slice("_ld_lines", start(i) + 1, end - start(i))))
    added = {
        "kept_text": F.when(F.col("_ld_at").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size("_ld_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_ld_at"), F.lit(0)).cast("long"),
    }
    done = marked.select("row", F.struct(*[v.alias(k) for k, v in added.items()]).alias("added"))
    return done.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added], "added.*")
