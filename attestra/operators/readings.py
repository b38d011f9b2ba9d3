"""From documents to validated readings: scripted replies by content hash, strict validation, bounded retries."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import schemas
from attestra.functions.bound import let
from attestra.functions.codes import is_alpha2, is_alpha3
from attestra.functions.dates import iso_date

MOST_ATTEMPTS = 3
#: What a replay and those who read its outcome expect word for word.
NOT_JSON = "The reply was not valid JSON for the schema."
REFUSAL = "__refusal__"
NO_ANSWER = "no recorded answer for this document"
#: What a field may look like: value and quote, each text or null.
_SHAPES = [f"OBJECT<quote: {q}, value: {v}>" for q in ("STRING", "VOID") for v in ("STRING", "VOID")]
DIRECTORS = "directors"


def _form(group: str, field: str) -> str:
    if field in schemas.DATE_FIELDS:
        return "date"
    if group == "identity" and field in schemas.ALPHA3_FIELDS:
        return "alpha3"
    return "alpha2" if group != "identity" and field == "country" else "text"


#: The rules of replies: (family, place in it, field, form of its value). Directors are texts of a list of any length.
RULES = [(group, i, field, _form(group, field)) for group, names in schemas.FIELDS.items() for i, field in enumerate(names)]


class Reader(Protocol):
    """Anything that adds replies ARRAY<STRING> to documents: element i answers attempt i, the last one repeats."""

    def replies(self, documents: DataFrame) -> DataFrame: ...


class ReplayReader:
    """Answers from a table of scripts (sha256, replies)."""

    def __init__(self, scripts: DataFrame) -> None:
        self.scripts = scripts

    def replies(self, documents: DataFrame) -> DataFrame:
        scripts = self.scripts.select(F.col("sha256").alias("_script"), "replies")
        joined = documents.join(scripts, F.col("sha256") == F.col("_script"), "left").drop("_script")
        return joined.withColumn("replies", F.when(F.coalesce(F.size("replies"), F.lit(0)) < 1, F.array(F.lit(NO_ANSWER))).otherwise(F.col("replies")))


def family(kind: Column) -> Column:
    return F.when(kind.isin(*schemas.IDENTITY_KINDS), "identity").otherwise(kind)


def _rules(fam: Column) -> Column:
    """The rules of a family, in order, as an array."""
    every = F.array(*[F.struct(F.lit(g).alias("family"), F.lit(f).alias("field"), F.lit(form).alias("form")) for g, _, f, form in RULES])
    return F.filter(every, lambda r: r["family"] == fam)


def _value_error(name: Column, value: Column, quote: Column, form: Column) -> Column:
    """What is wrong with a value, if its shape is right."""
    about = lambda *text: F.concat(name, F.lit(": "), *[t if isinstance(t, Column) else F.lit(t) for t in text])
    blank = F.coalesce(F.regexp_replace(quote, r"(?U)\s+", ""), F.lit("")) == ""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(blank, about("value without a quote"))
        .when((form == "date") & ~value.rlike(r"^\d{4}-\d{2}-\d{2}$"), about("date '", value, "' is not in the form YYYY-MM-DD"))
        .when((form == "date") & iso_date(value).isNull(), about("no such day as '", value, "'"))
        .when((form == "alpha3") & ~is_alpha3(value), about("'", value, "' is no country code of three letters"))
        .when((form == "alpha2") & ~is_alpha2(value), about("'", value, "' is no country code of two letters"))
    )


def _judged(name: Column, member: Column, form: Column) -> Column:
    """struct(value, quote, error) of one member of a reply."""

    def judged(m: Column) -> Column:
        texts = [F.try_variant_get(m, f"$.{part}", "string").alias(part) for part in ("value", "quote")]
        return let(F.struct(F.schema_of_variant(m).alias("shape"), *texts), by_shape)

    def by_shape(x: Column) -> Column:
        error = (
            F.when(x["shape"].isNull(), F.concat(name, F.lit(": missing")))
            .when(~x["shape"].isin(*_SHAPES), F.concat(name, F.lit(": needs a value and a quote, each text or null")))
            .otherwise(_value_error(name, x["value"], x["quote"], form))
        )
        return F.struct(x["value"].alias("value"), x["quote"].alias("quote"), error.alias("error"))

    return let(member, judged)


def validate_reply(text: Column, kind: Column) -> Column:
    """struct(errors, identity, proof_of_address, company_extract): one of the values if there are no errors.

    The reply is parsed once, to its members; the rules of the document's family are joined to them as rows of an array,
    and one expression judges each member by its rule. What is used more than once is bound (`let`): an expression that is
    merely named would be computed again wherever it stands, a reply parsed for every member and question."""
    fam, none = family(kind), F.array().cast("array<string>")

    def judged(members: Column) -> Column:
        fields = F.transform(_rules(fam), lambda r: _judged(r["field"], F.try_element_at(members, r["field"]), r["form"]))
        people = F.when(fam == "company_extract", F.try_variant_get(F.try_element_at(members, F.lit(DIRECTORS)), "$", "array<variant>"))
        directors = F.transform(people, lambda p, i: _judged(F.concat(F.lit(f"{DIRECTORS}."), i.cast("string")), p, F.lit("text")))
        return F.struct(members.isNull().alias("lacks_members"), fields.alias("fields"), directors.alias("directors"))

    def done(said_text: Column, x: Column) -> Column:
        errors_of = lambda judgements: F.coalesce(F.array_compact(F.transform(judgements, lambda j: j["error"])), none)
        company = fam == "company_extract"
        unlisted = F.when(company & x["directors"].isNull(), F.array(F.lit(f"{DIRECTORS}: needs a list"))).otherwise(none)
        known = F.concat(F.transform(_rules(fam), lambda r: r["field"]), F.when(company, F.array(F.lit(DIRECTORS))).otherwise(none))
        extra = F.transform(F.array_except(F.json_object_keys(said_text), known), lambda k: F.concat(k, F.lit(": no such member")))
        errors = F.when(x["lacks_members"], F.array(F.lit("document: needs an object"))).otherwise(
            F.concat(errors_of(x["fields"]), unlisted, errors_of(x["directors"]), extra)
        )
        said = lambda j: F.struct(j["value"].alias("value"), j["quote"].alias("quote"))
        values = []
        for group, names in schemas.FIELDS.items():
            parts = [said(F.get(x["fields"], F.lit(i))).alias(n) for i, n in enumerate(names)]
            if group == "company_extract":
                parts.append(F.transform(x["directors"], said).alias(DIRECTORS))
            values.append((group, F.struct(*parts)))
        return let(errors, lambda e: F.struct(e.alias("errors"), *[F.when((fam == g) & (F.size(e) == 0), v).alias(g) for g, v in values]))

    typed = F.struct(F.array(F.lit(NOT_JSON)).alias("errors"), *[F.lit(None).cast(_type_of(g)).alias(g) for g in schemas.FIELDS])

    def read(t: Column) -> Column:
        members = lambda parsed: let(F.try_variant_get(parsed, "$", "map<string,variant>"), judged)
        found = lambda parsed: let(members(parsed), lambda x: done(t, x))
        return let(F.try_parse_json(t), lambda parsed: F.when(parsed.isNull() | ~fam.isin(*schemas.FIELDS), typed).otherwise(found(parsed)))

    return let(text, read)


def _type_of(group: str) -> str:
    field = "struct<value:string,quote:string>"
    members = [f"{n}:{field}" for n in schemas.FIELDS[group]] + ([f"{DIRECTORS}:array<{field}>"] if group == "company_extract" else [])
    return f"struct<{','.join(members)}>"


def read_documents(documents: DataFrame, reader: Reader) -> DataFrame:
    """documents with reading: struct(ok, attempts, failure, errors, identity, proof_of_address, company_extract).

    A reader's first valid reply of MOST_ATTEMPTS counts; a refusal ends the attempts. A script's replies are validated
    side by side as one array (its last reply, which repeats, once), so a retry is data, not a loop."""
    asked = reader.replies(documents)
    tried = F.transform(F.slice("replies", 1, MOST_ATTEMPTS), lambda r: F.struct((r == REFUSAL).alias("refused"), validate_reply(r, F.col("kind")).alias("got")))
    asked = asked.withColumn("_tried", tried).drop("replies")
    ends = F.transform("_tried", lambda x: x["refused"] | (F.size(x["got"]["errors"]) == 0))
    asked = asked.withColumn("_end", F.array_position(ends, True)).withColumn(
        "_last", F.element_at("_tried", F.when(F.col("_end") > 0, F.col("_end").cast("int")).otherwise(-1))
    )
    ended, refused = F.col("_end") > 0, F.col("_last.refused")
    ok = ended & ~refused
    none = F.array().cast("array<string>")
    reading = F.struct(
        ok.alias("ok"),
        F.when(ended, F.col("_end").cast("int")).otherwise(MOST_ATTEMPTS).alias("attempts"),
        F.when(~ended, "invalid_after_retries").when(refused, "refused").alias("failure"),
        F.when(ok, none).when(ended, F.array(F.lit("reader refused"))).otherwise(F.col("_last.got.errors")).alias("errors"),
        *[F.when(ok, F.col(f"_last.got.{g}")).alias(g) for g in schemas.FIELDS],
    )
    return asked.withColumn("reading", reading).drop("_tried", "_end", "_last")
