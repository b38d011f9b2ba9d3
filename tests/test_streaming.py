"""The event log, the intake stream and the timers: exactly once, across failures and restarts."""

import base64
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from attestra.sources import intake
from attestra.streaming import intake_stream, lifecycle
from attestra.streaming.event_log import EventLog, add_each_batch

SCHEMA = lifecycle.COMMANDS


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def events(spark, *seqs, case="a"):
    return spark.createDataFrame([(s, case, "case_submitted", None, None) for s in seqs], SCHEMA)


def seqs(log):
    return sorted(r.seq for r in log.read().collect())


def test_the_log_only_grows(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), SCHEMA)
    assert seqs(log) == [] and log.append(events(spark), None)
    assert log.append(events(spark, 1, 2, 3)) and log.append(events(spark, 7, 9))
    for bad in ((3,), (4, 4), (0, 9), (None,)):
        with pytest.raises(ValueError, match="append-only"):
            log.append(events(spark, *bad))
    assert log.append(events(spark, 8)) and seqs(log) == [1, 2, 3, 7, 8, 9]
    assert len(list((tmp_path / "log" / "data").iterdir())) == 3 == len(log.commits())


def test_a_named_batch_is_added_once(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), SCHEMA)
    assert log.append(events(spark, 1), "s:0") and log.append(events(spark), "s:1")
    assert not log.append(events(spark, 1), "s:0") and not log.append(events(spark, 5), "s:1")
    assert log.append_numbered(events(spark, 0, 0, 0).drop("seq").repartition(3), "n:0") and not log.append_numbered(events(spark, 0).drop("seq"), "n:0")
    assert seqs(log) == [1, 2, 3, 4]


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "log"), EventLog._commit
    log, rival = EventLog(spark, path, SCHEMA), EventLog(spark, path, SCHEMA)
    log.append(events(spark, 1))

    def beaten(rows):
        def commit(self, number, says):
            monkeypatch.setattr(EventLog, "_commit", real)
            assert rival.append(rows)  # after this batch was judged, before it is put in place
            return real(self, number, says)

        monkeypatch.setattr(EventLog, "_commit", commit)

    beaten(events(spark, 2, 3))
    with pytest.raises(ValueError, match="append-only"):
        log.append(events(spark, 3, 4))
    beaten(events(spark, 5))
    assert log.append(events(spark, 6))
    beaten(events(spark, 7, case="rival"))
    assert log.append_numbered(events(spark, 0).drop("seq"))  # numbered anew behind the rival's
    assert seqs(log) == [1, 2, 3, 5, 6, 7, 8] and log.read().where("seq = 7").first().case_id == "rival"


@pytest.mark.parametrize("moment", ["before the commit", "after the commit"])
def test_a_killed_stream_adds_each_event_once(spark, tmp_path, monkeypatch, moment):
    for i in range(4):
        events(spark, *range(10 * i, 10 * i + 5), case=f"c{i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log, real = EventLog(spark, str(tmp_path / "log"), SCHEMA), EventLog._commit

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(add_each_batch(log, "s")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination(180)

    calls = []

    def killed(self, number, says):
        calls.append(number)
        if len(calls) == 2:
            if moment == "after the commit":
                real(self, number, says)
            raise RuntimeError("killed")
        return real(self, number, says)

    monkeypatch.setattr(EventLog, "_commit", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    assert len(log.commits()) == (1 if moment == "before the commit" else 2)
    run()
    assert seqs(log) == [10 * i + j for i in range(4) for j in range(5)] and len(log.commits()) == 4


# --- timers ------------------------------------------------------------------------------------------------------

MINUTE, HOUR = 60_000, 3_600_000
AT = dt.datetime(2026, 1, 1)
TIMED = [
    (1, "a", "case_submitted", None, None, 0), (2, "a", "checks_completed", "in_review", None, 20), (3, "a", "review_decided", "approved", 2, 30),
    (4, "b", "case_submitted", None, None, 5), (5, "b", "checks_completed", "approved", None, 300),  # after its patience
    (6, "c", "case_submitted", None, None, 10), (7, "c", "case_submitted", None, None, 50),  # silent; a second submission moves no deadline
    (8, "d", "case_submitted", None, None, 15), (9, "d", "processing_interrupted", None, None, 74), (10, "d", "review_decided", "rejected", 2, 80),
    (11, "e", "case_submitted", None, None, 700),  # still has time at the end
    (12, "f", "review_decided", "approved", 1, 100), (13, "c", "review_decided", "approved", 2, 400), (14, "g", "case_submitted", None, None, 400),
]


def timed(spark, rows):
    return spark.createDataFrame([(*r[:5], AT + dt.timedelta(minutes=r[5])) for r in rows], lifecycle.TIMED_COMMANDS)


def plain(df):
    return sorted((tuple(r) for r in df.select("case_id", "seq", "event", "from_status", "to_status", "version", "refusal", "at").collect()), key=str)


def test_patience_in_batch(spark):
    until = int(AT.replace(tzinfo=dt.UTC).timestamp() * 1000) + 700 * MINUTE
    rows = plain(lifecycle.fold_with_patience(timed(spark, TIMED), HOUR, until))
    ended = {r[0]: r[7] for r in rows if r[1] is None}
    assert ended == {c: AT + dt.timedelta(minutes=m) for c, m in (("b", 65), ("c", 70), ("g", 460))}
    by = {r[1]: r for r in rows if r[1]}
    assert by[5][6] == "not_found" and by[13][4:6] == ("approved", 3) and by[9][5:7] == (2, None) and by[3][4] == "approved"
    assert not [r for r in plain(lifecycle.fold_with_patience(timed(spark, TIMED), HOUR)) if r[0] == "g" and r[1] is None]
    assert [r[2:6] for r in plain(lifecycle.fold_with_patience(timed(spark, TIMED), 1 << 50)) if r[0] == "b"] == [r[2:6] for r in plain(lifecycle.fold(timed(spark, TIMED)).withColumn("at", F.lit(None))) if r[0] == "b"]


def test_timers_across_a_restart_are_as_in_batch(spark, rocks, tmp_path):
    """The stream stops after half the commands and starts again from its checkpoint; a timer set before fires after."""
    ordered = sorted(TIMED, key=lambda r: r[5])
    files = [ordered[:4], ordered[4:8], ordered[8:12], ordered[12:], [(99, "z", "case_submitted", None, None, 800)]]

    def run():
        source = spark.readStream.schema(lifecycle.TIMED_COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = lifecycle.fold_stream_with_patience(source, HOUR, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at"))
        q.trigger(availableNow=True).start().awaitTermination(240)

    for i, rows in enumerate(files):
        timed(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i in (1, 4):
            run()
    until = int(AT.replace(tzinfo=dt.UTC).timestamp() * 1000) + 800 * MINUTE
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == plain(lifecycle.fold_with_patience(timed(spark, [r for f in files for r in f]), HOUR, until))


# --- intake ------------------------------------------------------------------------------------------------------

PDF = base64.b64encode(b"%PDF-1.7 text").decode()
FORM = {
    "full_name": "Vera Modell", "date_of_birth": "1990-02-03", "nationality": "DEU", "iban": None, "company": None,
    "address": {"line": "Musterweg 1", "postcode": "10115", "city": "Berlin", "country": "DE"},
}


def submission(documents=None, **changes):
    return {"application": FORM | changes, "documents": documents if documents is not None else [{"kind": "passport", "media_type": "application/pdf", "content": PDF}]}


FILES = [
    [submission(), submission(), submission(full_name="x" * 201, nationality="XXX")],
    [submission([]), submission([{"kind": "passport", "media_type": "image/png", "content": PDF}, {"kind": "passport", "media_type": "application/pdf", "content": "no base64"}])],
    [],
    [submission(full_name=f"Nr {i}") for i in range(20)],
]


def test_intake_stream_equals_one_reading(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(FILES):
        (tmp_path / "in" / f"f{i}.json").write_text("\n".join(json.dumps(r) for r in rows) + ("\nno json\n" if i == 1 else ""))
    log, real, calls = intake_stream.intake_log(spark, str(tmp_path / "log")), EventLog._commit, []

    def killed(self, number, says):
        calls.append(number)
        if len(calls) in (2, 4):
            if len(calls) == 4:
                real(self, number, says)
            raise RuntimeError("killed")
        return real(self, number, says)

    def run():
        intake_stream.start_intake(spark, str(tmp_path / "in"), log, str(tmp_path / "at"), files_per_batch=1, availableNow=True).awaitTermination(180)

    monkeypatch.setattr(EventLog, "_commit", killed)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    run()
    whole = intake_stream.as_events(intake_stream.with_source(intake.read_submissions(spark, str(tmp_path / "in"))))
    of = lambda df: sorted(map(tuple, df.select(*whole.columns).collect()), key=str)
    assert of(log.read()) == of(whole)
    rows = log.read().collect()
    assert sorted(r.seq for r in rows) == list(range(len(rows))) and len({r.case_id for r in rows}) == len(rows) == 26
    refused = sorted(len(json.loads(r.detail)["errors"]) for r in rows if r.event == intake_stream.REFUSED)
    assert len(refused) == 4 and refused[:3] == [1, 2, 2]
    detail = json.loads(next(r.detail for r in rows if r.event == intake_stream.SUBMITTED and "Vera" in r.detail))
    assert detail["application"]["full_name"] == "Vera Modell" and len(detail["documents"][0]["sha256"]) == 64
    folded = lifecycle.fold(log.read()).groupBy("event", "refusal").count().collect()
    assert {(r["event"], r["refusal"]): r["count"] for r in folded} == {("case_submitted", None): 22, ("submission_refused", "not_found"): 4}
