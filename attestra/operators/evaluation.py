"""Evaluation of decisions and readings against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import scored_text
from attestra.schemas import FIELDS, OUTCOMES


def label_of(live: bool) -> Column:
    return F.coalesce("expected_live", "expected") if live else F.col("expected")


def judged_cases(decisions: DataFrame, labels: DataFrame, live: bool = False) -> DataFrame:
    """(case_id, scenario, hard, want, got), one row a label; got is null for a case without a decision."""
    return labels.join(decisions, "case_id", "left").select("case_id", "scenario", "hard", label_of(live).alias("want"), F.col("outcome").alias("got"))


def differing(judged: DataFrame) -> DataFrame:
    """The cases that were not decided as wanted, as rows."""
    return judged.where(~F.col("want").eqNullSafe(F.col("got"))).select("case_id", "scenario", "want", "got")


def confusion(judged: DataFrame) -> DataFrame:
    """want by got, with zero cells and rows."""
    wanted = judged.sparkSession.createDataFrame([(i, o) for i, o in enumerate(OUTCOMES)], "place int, want string")
    counts = judged.groupBy("want").pivot("got", list(OUTCOMES)).count()
    return wanted.join(counts, "want", "left").orderBy("place").select("want", *[F.coalesce(o, F.lit(0)).alias(o) for o in OUTCOMES])


def percent(n: Column, total: Column) -> Column:
    return F.when(total == 0, "n/a").otherwise(F.format_string("%.1f%%", 100.0 * n / total))


def summary(judged: DataFrame) -> DataFrame:
    """One row of counts and rates."""
    wrong_way = lambda o: (F.col("got") == o) & (F.col("want") != o)
    sums = judged.agg(
        F.count("*").alias("cases"),
        *[F.count_if(F.col("got") == o).alias(o) for o in OUTCOMES],
        F.count_if(F.col("want") != "approved").alias("not_approvable"),
        F.count_if("hard").alias("hard_cases"),
        F.count_if(wrong_way("approved")).alias("false_approvals"),
        F.count_if(wrong_way("approved") & F.col("hard")).alias("hard_false_approvals"),
        F.count_if(wrong_way("rejected")).alias("false_rejections"),
        F.count_if(F.col("got") != F.col("want")).alias("mismatches"),
        F.count_if(F.col("got").isNull()).alias("undecided"),
    )
    rates = [percent(F.col(o), F.col("cases")).alias(f"{o}_rate") for o in OUTCOMES]
    return sums.select("*", *rates)


def gate(report: DataFrame, live: bool = False) -> DataFrame:
    """A lost case fails as a false approval does."""
    failed = (F.col("false_approvals") + F.col("undecided") > 0) | (F.lit(not live) & (F.col("mismatches") > 0))
    return report.select(failed.alias("failed"))


def reading_fields(documents: DataFrame) -> DataFrame:
    """(case_id, doc_index, group, field, value, values): the readings in long form; values for lists of people."""
    group = F.when(F.col("kind").isin("identity_card", "passport"), "identity").otherwise(F.col("kind"))
    none = F.lit(None).cast("array<string>")
    rows = []
    for g, names in FIELDS.items():
        rows += [F.struct(F.lit(g).alias("g"), F.lit(n).alias("field"), F.col(f"reading.{g}.{n}.value").alias("value"), none.alias("values")) for n in names]
    people = F.transform("reading.company_extract.directors", lambda d: d["value"])
    rows.append(F.struct(F.lit("company_extract").alias("g"), F.lit("directors").alias("field"), F.lit(None).cast("string").alias("value"), people.alias("values")))
    long = documents.select("case_id", "doc_index", group.alias("group"), F.inline(F.array(*rows)))
    return long.where("g = group").drop("g")


def field_scores(documents: DataFrame, truth: DataFrame) -> DataFrame:
    """(field, total, exact, normalised, exact_rate, normalised_rate) per group.field, over the truth's fields. A list that
    holds a null is compared like any other. A document without a truth and a truth without its document are errors, found
    by the same join."""
    got = reading_fields(documents).select("case_id", "doc_index", "group", "field", F.col("value").alias("got"), F.col("values").alias("got_list"))
    group = documents.select("case_id", "doc_index", F.when(F.col("kind").isin("identity_card", "passport"), "identity").otherwise(F.col("kind")).alias("of"))
    named = lambda what: F.raise_error(F.concat(F.lit(what), F.coalesce("case_id", F.lit("null")), F.lit(", "), F.coalesce(F.col("doc_index").cast("string"), F.lit("null"))))
    paired = truth.withColumn("known", F.lit(True)).join(group, ["case_id", "doc_index"], "full_outer")
    of = F.when(F.col("known").isNull(), named("a document without a truth: ")).when(F.col("of").isNull(), named("a truth without a document: ")).otherwise(F.col("of"))
    joined = paired.withColumn("of", of).drop("known").join(got, ["case_id", "doc_index", "field"], "left")
    listed = F.col("values").isNotNull()
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    exact = F.when(listed, F.array_sort(empty(F.col("values"))) == F.array_sort(empty(F.col("got_list")))).otherwise(F.col("value").eqNullSafe(F.col("got")))
    folded = joined.withColumn("want_texts", scored_text(F.when(listed, F.col("values")).otherwise(F.array("value"))))
    folded = folded.withColumn("got_texts", scored_text(F.when(listed, empty(F.col("got_list"))).otherwise(F.array("got"))))
    filled = lambda c: F.array_sort(F.transform(c, lambda x: F.coalesce(x, F.lit(""))))
    scored = folded.select(
        F.concat("of", F.lit("."), "field").alias("field"), exact.alias("is_exact"), (filled("want_texts") == filled("got_texts")).alias("is_same")
    )
    sums = scored.groupBy("field").agg(F.count("*").alias("total"), F.count_if("is_exact").alias("exact"), F.count_if("is_same").alias("normalised"))
    return sums.select("*", percent(F.col("exact"), F.col("total")).alias("exact_rate"), percent(F.col("normalised"), F.col("total")).alias("normalised_rate"))


def retried(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents"), F.count_if(F.col("reading.attempts") > 1).alias("retried"), F.sum("reading.attempts").alias("calls"))


def report_json(report: DataFrame, cells: DataFrame, fields: DataFrame, calls: DataFrame) -> DataFrame:
    """One row, one text: all figures as a JSON object. Every input is aggregated already and of fixed size."""
    one = lambda df, name: df.select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("text"))
    many = lambda df, name: df.agg(F.lit(name).alias("name"), F.to_json(F.sort_array(F.collect_list(F.struct("*")))).alias("text"))
    parts = one(report, "totals").unionByName(one(calls, "reading")).unionByName(many(cells, "confusion")).unionByName(many(fields, "fields"))
    members = F.transform(F.sort_array(F.collect_list(F.struct("name", "text"))), lambda p: F.concat(F.lit('"'), p["name"], F.lit('":'), p["text"]))
    return parts.agg(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("report"))


def markdown(report: DataFrame, cells: DataFrame, fields: DataFrame, calls: DataFrame, title: str) -> str:
    """The report as text; every input is aggregated already and of fixed size."""
    r, c = report.first(), calls.first()
    bad = r["not_approvable"]
    measures = {
        "approved though they should not be": f"{r['false_approvals']} out of {bad}",
        "of these, hard cases": f"{r['hard_false_approvals']} out of {r['hard_cases']}",
        "decided as labelled": f"{r['cases'] - r['mismatches'] - r['undecided']} out of {r['cases']}",
        "without a decision": r["undecided"],
        "rejected though they should not be": r["false_rejections"],
        **{o: f"{r[o]} = {r[f'{o}_rate']}" for o in OUTCOMES},
        "documents asked for more than once": f"{c['retried']} out of {c['documents']}",
    }
    grid = lambda head, rows: ["| " + " | ".join(map(str, x)) + " |" for x in (head, ["---"] * len(head), *rows)]
    parts = [
        [f"# {title}"],
        grid(("cases", "number"), measures.items()),
        grid(("label", *OUTCOMES), [(x["want"], *(x[o] for o in OUTCOMES)) for x in cells.collect()]),
        grid(("field", "readings", "same", "same but for writing"), [(x["field"], x["total"], x["exact_rate"], x["normalised_rate"]) for x in fields.orderBy("field").collect()]),
    ]
    return "\n\n".join("\n".join(p) for p in parts) + "\n"
