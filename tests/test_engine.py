"""Readings, checks, routing, evaluation: the specimen set end to end and hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from attestra import schemas
from attestra.operators import evaluation, readings, routing
from attestra.plans.verification import verify
from attestra.sources import intake, specimens


@pytest.fixture(scope="module")
def run(spark):
    cases = specimens.specimen_cases(spark)
    docs = specimens.documents(cases).cache()
    got = verify(specimens.applications(cases), docs, readings.ReplayReader(specimens.scripts(docs)), F.lit(specimens.REFERENCE_DATE).cast("date"))
    checks = got.checks.cache()
    judged = evaluation.judged_cases(routing.route(specimens.applications(cases), checks), specimens.labels(cases)).cache()
    return cases, docs, got.documents, checks, judged


def test_every_case_is_decided_as_labelled(run):
    report = evaluation.summary(run[4]).first()
    assert (report.cases, report.approved, report.in_review, report.rejected) == (56, 25, 25, 6)
    assert (report.false_approvals, report.false_rejections, report.mismatches, report.undecided) == (0, 0, 0, 0)
    assert evaluation.differing(run[4]).isEmpty() and not evaluation.gate(evaluation.summary(run[4])).first().failed


def test_a_lost_case_fails_the_gate(run):
    lost = evaluation.judged_cases(run[4].select("case_id", F.col("got").alias("outcome")).limit(55), specimens.labels(run[0]))
    report = evaluation.summary(lost)
    assert report.first().cases == 56 and report.first().undecided == 1 and evaluation.differing(lost).count() == 1
    assert evaluation.gate(report).first().failed and evaluation.gate(report, live=True).first().failed


def test_reports(run):
    report, cells = evaluation.summary(run[4]), evaluation.confusion(run[4])
    fields, calls = evaluation.field_scores(run[2], specimens.truth(run[1])), evaluation.retried(run[2])
    got = json.loads(evaluation.report_json(report, cells, fields, calls).first().report)
    assert got["totals"]["cases"] == 56 and got["reading"]["documents"] == 117 and len(got["confusion"]) == 3 and len(got["fields"]) == fields.count()
    assert "25 = 44.6%" in evaluation.markdown(report, cells, fields, calls, "Specimens")


def test_the_planted_fault_is_what_fails(run):
    open_ = {(r.case_id.rsplit("-", 1)[0], r.name) for r in run[3].where("status <> 'pass'").collect()}
    for pair in [
        ("name_mismatch", "identity_name_matches_application"),
        ("expired_id", "document_not_expired"),
        ("forged_mrz_check_digit", "mrz_check_digits"),
        ("address_mismatch", "address_matches_application"),
        ("prompt_injection", "no_embedded_instructions"),
        ("misread_birth_date", "quotes_grounded"),
        ("stale_proof_of_address", "address_document_recent"),
        ("minor_applicant", "holder_is_adult"),
        ("iban_typo", "iban_valid"),
        ("not_a_director", "applicant_is_director"),
        ("company_dissolved", "company_active"),
        ("missing_proof_of_address", "documents_complete"),
        ("model_refuses", "extraction"),
        ("clean_photo", "quotes_grounded"),
    ]:
        assert pair in open_, pair
    assert not any(s.startswith("clean_") and s != "clean_photo" for s, _ in open_)


def test_field_scores_and_retries(run):
    scores = {r.field: r for r in evaluation.field_scores(run[2], specimens.truth(run[1])).collect()}
    assert scores["identity.surname"].total == 56 and scores["company_extract.directors"].exact == 6
    calls = evaluation.retried(run[2]).first()
    assert (calls.documents, calls.retried) == (117, 5)


@pytest.mark.parametrize("lost", ["document", "truth"])
def test_field_scores_need_every_pair(run, lost):
    documents, truth = run[2], specimens.truth(run[1])
    one = (F.col("case_id") == "clean_passport_bank-000001") & (F.col("doc_index") == 1)
    documents, truth = (documents.where(~one), truth) if lost == "document" else (documents, truth.where(~one))
    with pytest.raises(Exception, match="a truth without a document: clean" if lost == "document" else "a document without a truth: clean"):
        evaluation.field_scores(documents, truth).collect()


def test_specimens_repeat(spark, run):
    again = specimens.documents(specimens.specimen_cases(spark))
    assert sorted(r.sha256 for r in again.select("sha256").collect()) == sorted(r.sha256 for r in run[1].select("sha256").collect())


def field(value, quote="q"):
    return {"value": value, "quote": quote}


COMPANY = {"company_name": field("A"), "registration_number": field("1"), "country": field("NL"), "status": field("active"), "directors": [field("B")]}


@pytest.mark.parametrize(
    "change, error",
    [
        ({}, None),
        ({"extra": 1}, "extra: no such member"),
        ({"status": field("active", " ")}, "status: value without a quote"),
        ({"status": field(None, None)}, None),
        ({"status": field(5)}, "status: needs a value"),
        ({"country": field("XX")}, "country: 'XX' is no country code of two letters"),
        ({"directors": [field("B", None)]}, "directors.0: value without a quote"),
        ({"directors": None}, "directors: needs a list"),
        ({"status": None}, "status: needs a value"),
    ],
)
def test_replies_are_validated(spark, change, error):
    text = json.dumps(COMPANY | change)
    got = spark.createDataFrame([(text, "company_extract")], "t string, k string").select(readings.validate_reply(F.col("t"), F.col("k")).alias("g")).first().g
    if error is None:
        assert got.errors == [] and got.company_extract.company_name.value == "A"
    else:
        assert any(error in e for e in got.errors) and got.company_extract is None


def brute_errors(text, kind):
    """What is wrong with a reply, in plain Python."""
    import datetime as dt
    import re

    group = "identity" if kind in schemas.IDENTITY_KINDS else kind
    if group not in schemas.FIELDS:
        return [readings.NOT_JSON]
    try:
        reply = json.loads(text)
    except ValueError:
        return [readings.NOT_JSON]
    if not isinstance(reply, dict):
        return ["document: needs an object"]

    def judged(name, holder, key, form):
        if key not in holder:
            return [f"{name}: missing"]
        v = holder[key]
        if not isinstance(v, dict) or set(v) != {"value", "quote"} or not all(x is None or isinstance(x, str) for x in v.values()):
            return [f"{name}: needs a value and a quote, each text or null"]
        value, quote = v["value"], v["quote"]
        if value is None:
            return []
        if not (quote or "").strip():
            return [f"{name}: value without a quote"]
        if form == "date":
            if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value):
                return [f"{name}: date '{value}' is not in the form YYYY-MM-DD"]
            try:
                dt.date.fromisoformat(value)
            except ValueError:
                return [f"{name}: no such day as '{value}'"]
        for form_of, codes, n in (("alpha3", {"NLD", "DEU"}, "three"), ("alpha2", {"NL"}, "two")):
            if form == form_of and value not in codes:
                return [f"{name}: '{value}' is no country code of {n} letters"]
        return []

    errors = [e for g, _, f, form in readings.RULES if g == group for e in judged(f, reply, f, form)]
    names = [f for g, _, f, _ in readings.RULES if g == group]
    if group == "company_extract":
        names.append("directors")
        people = reply.get("directors")
        errors += ["directors: needs a list"] if not isinstance(people, list) else [e for i in range(len(people)) for e in judged(f"directors.{i}", dict(enumerate(people)), i, "text")]
    return errors + [f"{k}: no such member" for k in reply if k not in names]


def test_random_replies_have_the_errors_of_plain_python(spark):
    import random

    rng, rows = random.Random(6), []
    values = [None, "x", "", "NL", "NLD", "XX", "2024-02-29", "2023-02-29", "24-1-1", "2024-02-29 ", 5, True, [], "active", "\u00a0"]
    one = lambda: rng.choice([field(rng.choice(values), rng.choice(["q", "q", "q", None, " ", "\u2003", 3])), field("x"), field(None, None), None, "text", {"value": "x"}, field("x") | {"more": 1}, [field("x")]])
    for i in range(600):
        kind = rng.choice([*schemas.KINDS, "diploma"])
        group = "identity" if kind in schemas.IDENTITY_KINDS else kind
        fine = {"country": field("NL"), "nationality": field("NLD"), "issuing_country": field("DEU")} | {d: field("2024-02-29") for d in schemas.DATE_FIELDS}
        reply = {f: fine.get(f, field("v")) for f in schemas.FIELDS.get(group, ())} | ({"directors": [field("a"), field("b")]} if group == "company_extract" else {})
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            reply[rng.choice([*reply, "zusatz", "a.b", "directors"])] = one()
        if reply and rng.random() < 0.3:
            reply.pop(rng.choice(list(reply)))
        if group == "company_extract" and rng.random() < 0.4:
            reply["directors"] = rng.choice([[], [one() for _ in range(3)], None, "x", {}])
        text = json.dumps(reply)
        rows.append((i, kind, rng.choice([text] * 12 + [text[:-1], "[1]", "null", "sorry", "", '"x"'])))
    got = spark.createDataFrame(rows, "i int, k string, t string").select("i", readings.validate_reply(F.col("t"), F.col("k")).alias("g")).collect()
    by = {r.i: r.g for r in got}
    assert {i: by[i].errors for i, _, _ in rows} == {i: brute_errors(t, k) for i, k, t in rows}
    fine = [(i, k, t) for i, k, t in rows if not by[i].errors]
    assert len(fine) > 60
    for i, k, t in fine:
        group, reply = "identity" if k in schemas.IDENTITY_KINDS else k, json.loads(t)
        got_fields = by[i][group].asDict(recursive=True)
        assert got_fields == {f: reply[f] for f in got_fields} and all(by[i][g] is None for g in schemas.FIELDS if g != group)


def test_all_errors_come_at_once_and_text_is_no_json(spark):
    two = json.dumps(COMPANY | {"country": field("XX"), "status": field("a", None)})
    rows = spark.createDataFrame([(two,), ("sorry",), ("[1]",), (None,)], "t string").select(readings.validate_reply(F.col("t"), F.lit("company_extract")).alias("g")).collect()
    assert [len(r.g.errors) for r in rows] == [2, 1, 1, 1] and rows[1].g.errors == [readings.NOT_JSON]


@pytest.mark.parametrize("content, media, problem", [("JVBERi0xLjQ=", "application/pdf", None), ("####", "application/pdf", "base64"), ("JVBERi0xLjQ", "application/pdf", "base64"), ("JVBERi0x LjQ=", "application/pdf", "base64"), ("JVBERi0xLjQ=", "image/png", "like image/png")])
def test_uploads(spark, content, media, problem):
    got = spark.range(1).select(intake.upload_problem(F.lit(content), F.lit(media)).alias("p")).first().p
    assert got is None if problem is None else problem in got


def test_intake_collects_form_errors(spark, tmp_path):
    good = {"application": {"full_name": "A B", "date_of_birth": "1990-01-01", "nationality": "NLD", "address": {"line": "x 1", "postcode": "1", "city": "y", "country": "NL"}}, "documents": [{"kind": "passport", "media_type": "application/pdf", "content": "JVBERi0xLjQ="}]}
    bad = json.loads(json.dumps(good))
    bad["application"] |= {"full_name": "", "nationality": "XXX"}
    bad["documents"] = []
    (tmp_path / "a.json").write_text(json.dumps(good) + "\n" + json.dumps(bad))
    rows = intake.accept(intake.read_submissions(spark, str(tmp_path))).collect()
    assert sorted(len(r.errors) for r in rows) == [0, 3]


def test_a_reply_is_parsed_once_and_a_member_taken_once(spark):
    """Counted in the plan: an expression stands as often as it is computed."""
    rows = spark.createDataFrame([("{}", "passport")], "t string, k string").select(readings.validate_reply(F.col("t"), F.col("k")).alias("g"))
    whole = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    plan = rows._jdf.queryExecution().analyzed().toString().lower()
    spark.conf.set("spark.sql.debug.maxToStringFields", whole)
    assert plan.count("parse_json(") == 1 and plan.count("schema_of_variant(") + plan.count("schemaofvariant") == 2
