"""Case intake: submissions as JSON with an explicit schema, uploads decoded and fingerprinted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra import schemas
from attestra.functions.codes import is_alpha2, is_alpha3

MOST_DOCUMENTS, MOST_BYTES = 6, 10 * 1024 * 1024
#: The first bytes of each media type, as hex.
MAGIC = {"application/pdf": "25504446", "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF"}


def read_submissions(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.SUBMISSIONS).json(path)


def strict_base64(c: Column) -> Column:
    """Is the alphabet, the padding and the length of base64 right? The decoder alone lets spaces and missing padding pass."""
    return c.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.char_length(c) % 4 == 0)


def upload_problem(content: Column, media_type: Column) -> Column:
    """Why an upload is refused; null if it is fine."""
    raw = F.try_to_binary(content, F.lit("base64"))
    starts = F.lit(False)
    for kind, magic in MAGIC.items():
        starts = starts | ((media_type == kind) & F.startswith(F.hex(F.substring(raw, 1, 8)), F.lit(magic)))
    return (
        F.when(~strict_base64(content) | raw.isNull(), "no strict base64")
        .when(F.octet_length(raw) > MOST_BYTES, "over 10 MiB")
        .when(~starts, F.concat(F.lit("does not begin like "), media_type))
    )


def decode_uploads(submissions: DataFrame, key: str = "case_id") -> DataFrame:
    """One row per document: key, doc_index, kind, media_type, content, sha256, problem."""
    rows = submissions.select(key, F.posexplode("documents").alias("doc_index", "d")).select(key, "doc_index", "d.*")
    checked = rows.withColumn("problem", upload_problem(F.col("content"), F.col("media_type")))
    raw = F.when(F.col("problem").isNull(), F.try_to_binary("content", F.lit("base64")))
    return checked.withColumn("content", raw).withColumn("sha256", F.sha2("content", 256))


def application_errors(a: Column) -> Column:
    """All that is wrong with an application form, as an array of messages."""

    def sized(field: str, most: int, least: int = 1, needed: bool = True):
        value = a
        for part in field.split("."):
            value = value[part]
        bad = ~F.char_length(value).between(least, most)
        return F.when((value.isNull() if needed else F.lit(False)) | bad, f"{field}: {least} to {most} characters are needed")

    company = a["company"].isNotNull()
    checks = [
        sized("full_name", 200),
        F.when(a["date_of_birth"].isNull(), "date_of_birth: needs a day that exists"),
        F.when(~F.coalesce(is_alpha3(a["nationality"]), F.lit(False)), "nationality: no country code of three letters"),
        sized("address.line", 200),
        sized("address.postcode", 20),
        sized("address.city", 100),
        F.when(~F.coalesce(is_alpha2(a["address"]["country"]), F.lit(False)), "address.country: no country code of two letters"),
        sized("iban", 42, 0, needed=False),
        F.when(company, sized("company.name", 200)),
        F.when(company, sized("company.registration_number", 50)),
        F.when(company & ~F.coalesce(is_alpha2(a["company"]["country"]), F.lit(False)), "company.country: no country code of two letters"),
    ]
    return F.array_compact(F.array(*checks))


def accept(submissions: DataFrame) -> DataFrame:
    """submissions with errors: form errors, document counts and kinds. Rows without errors are accepted."""
    kinds = F.transform("documents", lambda d: d["kind"])
    count = F.when(~F.coalesce(F.size("documents").between(1, MOST_DOCUMENTS), F.lit(False)), f"documents: 1 to {MOST_DOCUMENTS} are needed")
    kind = F.when(F.size(F.array_except(kinds, F.array(*[F.lit(k) for k in schemas.KINDS]))) > 0, "documents: unknown kind")
    return submissions.withColumn("errors", F.concat(application_errors(F.col("application")), F.array_compact(F.array(count, kind))))
