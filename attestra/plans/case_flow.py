"""Registered queries of intake, event log, patience and stores, over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import queue
from attestra.sources import case_store
from attestra.sources.folders import kept, working_folder
from attestra.streaming import intake_stream, lifecycle
from attestra.streaming.event_log import EventLog, add_each_batch

#: Milliseconds that a case may stay in processing.
PATIENCE = 12 * 3_600_000
_FIELDS = ("", "full_name", "nationality", "documents", "documents[0].content", "documents[1].content", "company.country,company.registration_number", "date_of_birth,iban", "documents")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def submissions(customers: DataFrame) -> DataFrame:
    """Forms with documents from customers. fault = key % 9: 1 a name too long, 2 no such nationality, 3 no documents, 4 not the
    said media type, 5 no base64, 6 a company without number and country, 7 no birth date and a long account number, 8 a
    kind of document that isn't known."""
    key = F.col("c_custkey")
    fault = key % 9
    company = F.struct(F.lit("Firm").alias("name"), F.lit("").alias("registration_number"), F.lit("ZZ").alias("country"))
    application = F.struct(
        F.when(fault == 1, F.repeat(F.lit("x"), F.lit(201))).otherwise(F.col("c_name")).alias("full_name"), F.when(fault != 7, F.lit("1980-05-06").cast("date")).alias("date_of_birth"),
        F.when(fault == 2, "XXX").otherwise("NLD").alias("nationality"),
        F.struct(*[F.lit(v).alias(k) for k, v in (("line", "Kerkweg 1"), ("postcode", "3511 AB"), ("city", "Utrecht"), ("country", "NL"))]).alias("address"),
        F.when(fault == 7, F.repeat(F.lit("9"), F.lit(43))).alias("iban"), F.when(fault == 6, company).alias("company"),
    )
    pdf = F.base64(F.encode(F.concat(F.lit("%PDF-1.4 "), key.cast("string")), "UTF-8"))
    document = lambda kind, media, content: F.struct(kind.alias("kind"), media.alias("media_type"), content.alias("content"))
    first = document(F.when(fault == 8, "diploma").otherwise("passport"), F.when(fault == 4, "image/png").otherwise("application/pdf"), pdf)
    second = document(F.lit("proof_of_address"), F.lit("application/pdf"), F.when(fault == 5, F.concat(F.lit(" "), pdf)).otherwise(pdf))
    documents = F.when(fault != 3, F.array(first, second)).otherwise(F.array().cast("array<struct<kind:string,media_type:string,content:string>>"))
    return customers.select("c_custkey", application.alias("application"), documents.alias("documents"), key.cast("string").alias("file"), F.lit("2001-08-01").cast("timestamp").alias("at"))


INTAKE_SQL = f"""SELECT c_custkey, CAST([0, 1, 1, 1, 1, 1, 2, 2, 1][CAST(c_custkey % 9 AS INTEGER) + 1] AS INTEGER) AS n_errors,
  {list(_FIELDS)}[CAST(c_custkey % 9 AS INTEGER) + 1] AS fields,
  CASE WHEN c_custkey % 9 = 0 THEN sha256('%PDF-1.4 ' || c_custkey) ELSE '' END AS first_sha256 FROM customer"""


def intake_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What intake says of each customer's submission, and the first document's fingerprint of those accepted."""
    judged = intake_stream.judged(submissions(_table(spark, sf_dir, "customer")))
    names = F.array_join(F.array_sort(F.transform("errors", lambda e: F.regexp_extract(e, r"^([^:]*):", 1))), ",")
    prints = F.get(F.transform(intake_stream.fingerprints(), lambda d: d["sha256"]), F.lit(0))
    return judged.select("c_custkey", F.size("errors").alias("n_errors"), names.alias("fields"), F.when(F.size("errors") == 0, prints).otherwise("").alias("first_sha256"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIMED_COMMANDS of events: signups submit, views complete checks, clicks interrupt, purchases and errors decide."""
    kind = F.col("event_type")
    event = F.when(kind == "signup", "case_submitted").when(kind == "view", "checks_completed").when(kind == "click", "processing_interrupted").otherwise("review_decided")
    to = F.when(kind == "view", "in_review").when(kind == "purchase", "approved").when(kind == "error", "rejected")
    expected = F.when(event == "review_decided", (F.col("event_id") % 2 + 2).cast("int"))
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("case_id"), event.alias("event"), to.alias("to_status"), expected.alias("expected_version"), F.col("ts").cast("timestamp").alias("at")
    )


def streamed_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as files, streamed into the event log batch by batch, and the log folded."""
    with working_folder(spark, "streamed-decide") as folder:
        commands(spark, sf_dir).drop("at").repartitionByRange(4, "seq").write.parquet(f"{folder}/in")
        log = EventLog(spark, f"{folder}/log", lifecycle.COMMANDS)
        stream = spark.readStream.schema(lifecycle.COMMANDS).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        add = add_each_batch(log, "events")
        stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
        folded = lifecycle.fold(log.read())
        return kept(folded.select("case_id", "seq", F.coalesce("to_status", F.lit("")).alias("to_status"), F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("refusal", F.lit("")).alias("refusal")))


PATIENCE_SQL = f"""WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
  s AS (SELECT user_id, min(i) AS i, arg_min(ms, i) + {PATIENCE} AS deadline FROM e WHERE event_type = 'signup' GROUP BY user_id),
  d AS (SELECT s.user_id, deadline, arg_min(e.ms, e.i) AS ended FROM s LEFT JOIN e ON e.user_id = s.user_id AND e.i > s.i AND e.event_type IN ('view', 'click') GROUP BY s.user_id, deadline)
  SELECT CAST(user_id AS VARCHAR) AS case_id, deadline AS interrupted_ms, 2 AS version FROM d WHERE coalesce(ended >= deadline, true) AND deadline <= (SELECT max(epoch_us(ts) // 1000) FROM events)"""


def patience_interrupts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases whose patience ran out before their checks did, up to the last event."""
    given = commands(spark, sf_dir)
    until = given.agg(F.unix_millis(F.max("at"))).first()[0]
    folded = lifecycle.fold_with_patience(given, PATIENCE, until)
    return folded.where("seq is null").select("case_id", F.unix_millis("at").alias("interrupted_ms"), "version")


def stored_queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as a queue store, and the page after a cursor read from it."""
    cases = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    with working_folder(spark, "queue") as folder:
        case_store.write_queue(cases, folder)
        page = case_store.stored_page(spark, folder, 100, (F.lit("1997-03-05 00:00:00").cast("timestamp_ntz"), 500), "F")
        return kept(page.select("id", "created_at"))


def stored_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a trail store, and every case's trail read from it."""
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("event"), F.col("ts").alias("at"))
    with working_folder(spark, "trails") as folder:
        case_store.write_trails(e, folder)
        trails = queue.audit_trails(case_store.read_trails(spark, folder))
        return kept(trails.select("case_id", "place", "seq", "event", "at"))


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's cursor, read back, and the version of an entity tag."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    tag = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('"'))).when(F.col("o_orderkey") % 3 == 1, F.lit("*")).otherwise(F.col("o_orderkey").cast("string"))
    cursor = queue.encode_cursor(F.col("at"), F.col("o_orderkey"))
    rows = o.select("o_orderkey", "at", cursor.alias("cursor"), tag.alias("tag"))
    back = queue.decode_cursor(F.when(F.col("o_orderkey") % 7 == 0, F.concat("cursor", F.lit("!"))).otherwise(F.col("cursor")))
    return rows.select("o_orderkey", "cursor", F.coalesce(back["id"], F.lit("")).alias("back"), F.coalesce(queue.version_of(F.col("tag")), F.lit(-1)).alias("version"))


CURSORS_SQL = """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t FROM orders)
  SELECT o_orderkey, replace(replace(base64(encode(t || '|' || o_orderkey)), '+', '-'), '/', '_') AS cursor,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS back, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey < 1000000000 THEN CAST(o_orderkey AS INTEGER) ELSE -1 END AS version FROM o"""

QUERIES = {f.__name__: f for f in (intake_errors, streamed_decide, patience_interrupts, stored_queue_page, stored_trails, cursors)}
#: streamed_decide, stored_queue_page and stored_trails give what the queries without a log or store give: their SQL is the same.
SQL = {"intake_errors": INTAKE_SQL, "patience_interrupts": PATIENCE_SQL, "cursors": CURSORS_SQL}
SAME_AS = {"streamed_decide": "optimistic_decide", "stored_queue_page": "review_queue_keyset", "stored_trails": "audit_trail"}
