"""The review queue: keyset pages over (created_at, id), opaque cursors, and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS, ROWS = 100, 20
_URLSAFE = ("+/", "-_")


def queue_page(cases: DataFrame, limit: int = ROWS, after: tuple | None = None, status: str = "in_review") -> DataFrame:
    """The first `limit` + 1 cases in review after the key: the one more tells whether there is a next page. The key's
    condition is written out, as only that form reaches the Parquet reader."""
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be 1 to {MOST_ROWS}")
    rows = cases.where(F.col("status") == status)
    if after is not None:
        at, key = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col("created_at") >= at) & ((F.col("created_at") > at) | (F.col("id") > key)))
    return rows.orderBy("created_at", "id").limit(limit + 1)


def queue_page_with_cursor(cases: DataFrame, limit: int = ROWS, after: tuple | None = None, status: str = "in_review") -> DataFrame:
    """The page alone, its rows with next: the cursor of the page after it, null if there is none."""
    page = queue_page(cases, limit, after, status)
    whole = Window.orderBy("created_at", "id")  # of limit + 1 rows
    ranked = page.withColumn("_place", F.row_number().over(whole))
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max(F.when(F.col("_place") == limit, encode_cursor(F.col("created_at"), F.col("id")))).over(everything)
    ranked = ranked.withColumn("next", F.when(F.max("_place").over(everything) > limit, last))
    return ranked.where(F.col("_place") <= limit).drop("_place")


def find_case(cases: DataFrame, case_id, key: str = "case_id") -> DataFrame:
    """The case; an unknown one is an error."""
    found = cases.where(F.col(key) == case_id).limit(1)
    if found.isEmpty():
        raise LookupError(f"no case {case_id}")
    return found


def encode_cursor(created_at: Column, key: Column) -> Column:
    return F.translate(F.base64(F.encode(F.concat(created_at.cast("string"), F.lit("|"), key.cast("string")), "UTF-8")), *_URLSAFE)


def decode_cursor(cursor: Column) -> Column:
    """struct(created_at, id) of a cursor; null for anything that is none."""
    plain = F.translate(cursor, *reversed(_URLSAFE))
    strict = cursor.rlike("^[A-Za-z0-9_-]+={0,2}$") & (F.char_length(cursor) % 4 == 0)
    parts = F.split(F.decode(F.try_to_binary(plain, F.lit("base64")), "UTF-8"), r"\|", -1)
    at = F.try_to_timestamp(F.get(parts, F.lit(0)))
    return F.when(strict & (F.size(parts) == 2) & at.isNotNull() & (F.get(parts, F.lit(1)) != ""), F.struct(at.alias("created_at"), F.get(parts, F.lit(1)).alias("id")))


def audit_trail(events: DataFrame, case_id: str) -> DataFrame:
    """A case's events in order; an unknown case is an error, not an empty trail."""
    found = events.where(F.col("case_id") == case_id)
    if found.isEmpty():
        raise LookupError(f"no case {case_id}")
    return found.orderBy("seq")


def audit_trails(events: DataFrame) -> DataFrame:
    """Every case's events with their place in its trail, from 1."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("seq")))


def version_of(if_match: Column) -> Column:
    """The version of an entity tag "n", null if it is none."""
    return F.regexp_extract(if_match, r'^"(\d{1,9})"$', 1).try_cast("int")
