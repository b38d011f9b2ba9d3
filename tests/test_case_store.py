"""Pages and lookups from the stores: the same rows, and how much of the files was read for them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attestra.operators import queue
from attestra.sources import case_store


def scanned(df):
    """(files, rows) that the scans of a run of df have read, and its rows."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    todo, files, read = [plan], 0, 0
    while todo:
        p = todo.pop()
        inner = p.getClass().getSimpleName()
        if inner.endswith("QueryStageExec"):
            todo.append(p.plan())
        if inner == "FileSourceScanExec":
            files += p.metrics().apply("numFiles").value()
            read += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return files, read, rows


def cases(spark, n):
    at = F.timestamp_seconds(F.lit(1_760_000_000) + F.floor(F.col("id") * 7919 % n / 3))  # three cases share a time
    status = F.when(F.col("id") % 5 == 0, "approved").otherwise("in_review")
    return spark.range(n).select(F.format_string("c%07d", "id").alias("id"), at.alias("created_at"), status.alias("status"), F.lit("x").alias("detail"))


@pytest.mark.parametrize("n", [1_000, 100_000])
def test_a_page_reads_its_row_groups_alone(spark, tmp_path, n):
    df, path = cases(spark, n), str(tmp_path / "queue")
    case_store.write_queue(df, path, group=100, chunk=max(400, n // 8))
    want = [(r.created_at, r.id) for r in df.where("status = 'in_review'").orderBy("created_at", "id").collect()]
    for at in (0, 1, 19, 20, len(want) // 2, len(want) - 21, len(want) - 3):
        after = want[at - 1] if at else None
        page = case_store.stored_page(spark, path, 20, after)
        files, read, rows = scanned(page)
        assert [(r.created_at, r.id) for r in rows] == want[at : at + 21]
        assert files <= 2 and read <= 300, (n, at, files, read)
    assert case_store.stored_page(spark, path, 20, want[-1]).count() == 0 == case_store.stored_page(spark, path, 20, status="none").count()
    with pytest.raises(ValueError):
        case_store.stored_page(spark, path, 101)


def test_pages_over_groups_of_few_rows(spark, tmp_path):
    """A page may need many groups."""
    df, path = cases(spark, 900), str(tmp_path / "queue")
    case_store.write_queue(df, path, group=2, chunk=50)
    for limit in (1, 100):
        after, seen = None, []
        for _ in range(9):
            page = case_store.stored_page(spark, path, limit, after).collect()
            plain = queue.queue_page(df, limit, after and tuple(F.lit(x) for x in after)).collect()
            assert [r.asDict() for r in page] == [r.asDict() for r in plain]
            seen += page[:limit]
            if len(page) <= limit:
                break
            after = (page[limit - 1].created_at, page[limit - 1].id)
        assert len({r.id for r in seen}) == len(seen) == (9 if limit == 1 else 720)


def test_an_empty_queue(spark, tmp_path):
    case_store.write_queue(cases(spark, 10).where("id is null"), str(tmp_path / "queue"))
    assert case_store.stored_page(spark, str(tmp_path / "queue")).count() == 0


@pytest.mark.parametrize("n", [2_000, 100_000])
def test_a_lookup_reads_one_file_and_few_groups(spark, tmp_path, n):
    path = str(tmp_path / "trails")
    events = spark.range(n).select(F.col("id").alias("seq"), F.format_string("c%d", F.col("id") % (n // 4)).alias("case_id"), F.lit("e").alias("event"))
    case_store.write_trails(events, path, buckets=8, group=100)
    for case in ("c0", "c17", f"c{n // 4 - 1}"):
        trail = case_store.stored_trail(spark, path, case)
        files, read, rows = scanned(trail)
        assert [r.seq for r in rows] == [int(case[1:]) + k * (n // 4) for k in range(4)]
        assert files == 1 and read <= 200, (files, read)
        assert case_store.stored_case(spark, path, case).first().seq == rows[-1].seq
    for unknown in ("c-1", "nobody"):  # inside and outside of the statistics' range; the Bloom filter leaves every group out
        absent = case_store._of(case_store.read_trails(spark, path), unknown)
        files, read, rows = scanned(absent)
        assert rows == [] and read == 0
        with pytest.raises(LookupError):
            case_store.stored_trail(spark, path, unknown)
    assert case_store.read_trails(spark, path).count() == n and dt is not None
