import datetime as dt

import pytest
from pyspark.sql import functions as F

from attestra.operators import queue
from attestra.streaming import lifecycle

ROWS = [
    (1, "a", "case_submitted", None, None),
    (2, "a", "checks_completed", "in_review", None),
    (3, "b", "case_submitted", None, None),
    (4, "b", "processing_interrupted", None, None),
    (5, "c", "review_decided", "approved", 2),
    (6, "b", "review_decided", "approved", 1),
    *[(10 + i, "a", "review_decided", "rejected", 2) for i in range(8)],
]


def commands(spark):
    return spark.createDataFrame(ROWS, lifecycle.COMMANDS)


def check(rows):
    by = {(r.case_id, r.seq): r for r in rows}
    wins = [r for r in rows if r.case_id == "a" and r.event == "review_decided" and r.refusal is None]
    assert len(wins) == 1 and wins[0].version == 3 and wins[0].to_status == "rejected"
    assert by["a", 11].refusal == "not_in_review" and by["b", 6].refusal == "version_mismatch" and by["c", 5].refusal == "not_found"
    assert (by["b", 4].to_status, by["b", 4].version) == ("in_review", 2)


def test_fold(spark):
    check(lifecycle.fold(commands(spark)).collect())


def test_fold_as_a_stream(spark, tmp_path):
    commands(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = lifecycle.fold_stream(spark.readStream.schema(lifecycle.COMMANDS).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    check(spark.read.parquet(str(tmp_path / "out")).collect())


def test_latest_orphans_interrupted(spark):
    last = {r.case_id: r.seq for r in lifecycle.latest(commands(spark)).collect()}
    assert last == {"a": 17, "b": 6, "c": 5}
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    assert [r.seq for r in lifecycle.orphans(commands(spark), cases).collect()] == [5]
    states = spark.createDataFrame([("a", "processing"), ("b", "approved")], "case_id string, status string")
    assert [r.case_id for r in lifecycle.interrupted(states).collect()] == ["a"]


def test_pages_cover_the_queue_once(spark):
    at = lambda i: dt.datetime(2026, 1, 1 + i // 3)
    cases = spark.createDataFrame([(f"c{i:02}", at(i), "in_review" if i % 4 else "approved") for i in range(30)], "id string, created_at timestamp_ntz, status string")
    seen, after = [], None
    while True:
        page = queue.queue_page(cases, 5, after).collect()
        seen += [r.id for r in page[:5]]
        if len(page) <= 5:
            break
        after = (F.lit(str(page[4].created_at)).cast("timestamp_ntz"), page[4].id)
    assert seen == [f"c{i:02}" for i in range(30) if i % 4]
    with pytest.raises(ValueError):
        queue.queue_page(cases, 101)
    with pytest.raises(LookupError):
        queue.audit_trail(spark.createDataFrame([(1, "a")], "seq long, case_id string"), "b")


def test_a_page_knows_the_next(spark):
    cases = spark.createDataFrame([(f"c{i:02}", dt.datetime(2026, 1, 1 + i), "in_review") for i in range(7)], "id string, created_at timestamp, status string")
    page = queue.queue_page_with_cursor(cases, 4)
    rows = page.collect()
    key = page.select(queue.decode_cursor(F.col("next")).alias("c")).first().c
    assert [r.id for r in rows] == ["c00", "c01", "c02", "c03"] and len({r.next for r in rows}) == 1 and (key.id, key.created_at) == ("c03", rows[3].created_at)
    last = queue.queue_page_with_cursor(cases, 4, (key.created_at, key.id)).collect()
    assert [r.id for r in last] == ["c04", "c05", "c06"] and all(r.next is None for r in last)
    assert queue.find_case(cases, "c05", "id").first().id == "c05"
    with pytest.raises(LookupError):
        queue.find_case(cases, "nobody", "id")


def test_cursor(spark):
    row = spark.range(1).select(F.lit("2026-01-02 03:04:05.000006").cast("timestamp").alias("t"), F.lit("k?>~").alias("k"))
    back = row.select(queue.decode_cursor(queue.encode_cursor(F.col("t"), F.col("k"))).alias("c"), "t").first()
    assert back.c.id == "k?>~" and back.c.created_at == back.t
    junk = spark.createDataFrame([("####",), ("",), ("YWJj",), ("YWJ",)], "c string").select(queue.decode_cursor(F.col("c")).alias("c")).collect()
    assert all(r.c is None for r in junk)
    tags = spark.createDataFrame([('"3"',), ("3",), ('W/"3"',), ("*",)], "t string").select(queue.version_of(F.col("t")).alias("v")).collect()
    assert [r.v for r in tags] == [3, None, None, None]
