"""Submissions as a stream: files of JSON are read once, judged and added to the event log, each batch by one commit.

Every submission becomes one event: `case_submitted` with the application and its documents' kinds and fingerprints, or
`submission_refused` with all errors. Events follow from the file alone (its name, its time, its rows), so that a batch
that is read again gives the same, and the log takes a batch once (`event_log`): a stream that is killed at any point and
started again leaves the log that one reading of all files gives, but for the numbers' order.

Defined cases: equal submissions of one file are cases of their own; a line that is no JSON is refused like an empty form; an empty file
adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.schemas import EVENTS
from attestra.sources import intake
from attestra.streaming.event_log import EventLog

SUBMITTED, REFUSED = "case_submitted", "submission_refused"


def with_source(submissions: DataFrame) -> DataFrame:
    """submissions as read from files, with the file's name and time."""
    return submissions.select("application", "documents", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("at"))


def judged(submissions: DataFrame) -> DataFrame:
    """submissions with all errors of form and uploads."""

    def of(document: Column, place: Column) -> Column:
        problem = intake.upload_problem(document["content"], document["media_type"])
        return F.when(problem.isNotNull(), F.concat(F.lit("documents["), place.cast("string"), F.lit("].content: "), problem))

    uploads = F.array_compact(F.transform(F.coalesce("documents", F.array()), of))
    return intake.accept(submissions).withColumn("errors", F.concat("errors", uploads))


def fingerprints() -> Column:
    """What an event keeps of the documents."""
    digest = lambda d: F.sha2(F.try_to_binary(d["content"], F.lit("base64")), 256)
    return F.transform("documents", lambda d: F.struct(d["kind"].alias("kind"), d["media_type"].alias("media_type"), digest(d).alias("sha256")))


def as_events(submissions: DataFrame) -> DataFrame:
    """EVENTS but for seq, of submissions (application, documents, file, at)."""
    digest = F.sha2(F.concat_ws("\n", "file", F.to_json(F.struct("application", "documents"))), 256)
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("at"))
    rows = judged(submissions).withColumn("digest", digest).withColumn("nth", nth)
    fine = F.size("errors") == 0
    detail = F.when(fine, F.to_json(F.struct("application", fingerprints().alias("documents")))).otherwise(F.to_json(F.struct("errors")))
    return rows.select(
        F.substring(F.sha2(F.concat_ws("#", "digest", "nth"), 256), 1, 32).alias("case_id"), F.col("at").cast("timestamp_ntz").alias("at"), F.lit("applicant").alias("actor"),
        F.when(fine, SUBMITTED).otherwise(REFUSED).alias("event"), F.lit(None).cast("string").alias("from_status"), F.when(fine, "processing").alias("to_status"),
        F.lit(None).cast("int").alias("expected_version"), detail.alias("detail"),
    )


def intake_log(spark: SparkSession, path: str) -> EventLog:
    return EventLog(spark, path, EVENTS)


def start_intake(spark: SparkSession, source: str, log: EventLog, checkpoint: str, files_per_batch: int = 1000, name: str = "intake", **trigger) -> StreamingQuery:
    """The running stream. trigger: as for DataStreamWriter.trigger, e.g. availableNow=True."""
    from attestra import schemas

    read = spark.readStream.schema(schemas.SUBMISSIONS).option("maxFilesPerTrigger", files_per_batch).json(source)

    def add(submissions: DataFrame, number: int) -> None:
        log.append_numbered(as_events(submissions), f"{name}:{number}")

    return with_source(read).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()
