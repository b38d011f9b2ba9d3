"""Routing: one aggregation from checks to decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """(case_id, outcome, reasons). A failed check that rejects rejects the case; all passed approves it; anything else, no
    checks included, goes to review. Statuses are text, never null, so that unknown routes like fail."""
    rejecting = (F.col("status") == "fail") & F.col("rejects")
    line = lambda text: F.struct("seq", text.alias("line"))
    why_rejected = F.when(rejecting, line(F.concat("name", F.lit(": "), "reason")))
    why_open = F.when(F.col("status") != "pass", line(F.concat("name", F.lit(" "), "status", F.lit(": "), "reason")))
    per_case = checks.groupBy("case_id").agg(
        F.bool_or(rejecting).alias("rejected"),
        F.bool_and(F.col("status") == "pass").alias("passed"),
        F.array_sort(F.collect_list(why_rejected)).alias("why_rejected"),
        F.array_sort(F.collect_list(why_open)).alias("why_open"),
    )
    lines = lambda c: F.transform(c, lambda x: x["line"])
    joined = cases.select("case_id").join(per_case, "case_id", "left")
    return joined.select(
        "case_id",
        F.when(F.col("rejected"), "rejected").when(F.col("passed"), "approved").otherwise("in_review").alias("outcome"),
        F.when(F.col("passed").isNull(), F.array(F.lit("nothing was checked"))).when(F.col("rejected"), lines("why_rejected")).otherwise(lines("why_open")).alias("reasons"),
    )


def open_checks(checks: DataFrame) -> DataFrame:
    """(case_id, open): names of the checks that a reviewer has to look at, in order."""
    left = checks.where("status <> 'pass'").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("c"))
    return left.select("case_id", F.transform("c", lambda x: x["name"]).alias("open"))
