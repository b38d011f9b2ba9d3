"""Explicit schemas of the entities; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

ADDRESS = "struct<line:string,postcode:string,city:string,country:string>"
COMPANY = "struct<name:string,registration_number:string,country:string>"
APPLICATIONS = f"case_id string, full_name string, date_of_birth date, nationality string, address {ADDRESS}, iban string, company {COMPANY}"
DOCUMENTS = "case_id string, doc_index int, kind string, media_type string, sha256 string, text_layer string"
REPLIES = "sha256 string, replies array<string>"
SUBMISSIONS = (
    f"application struct<full_name:string,date_of_birth:date,nationality:string,address:{ADDRESS},iban:string,company:{COMPANY}>, "
    "documents array<struct<kind:string,media_type:string,content:string>>"
)
EVENTS = "seq long, case_id string, at timestamp_ntz, actor string, event string, from_status string, to_status string, expected_version int, detail string"

IDENTITY_KINDS = ("identity_card", "passport")
KINDS = (*IDENTITY_KINDS, "proof_of_address", "company_extract")
MEDIA_TYPES = ("application/pdf", "image/png", "image/jpeg")
STATUSES = ("pass", "fail", "unknown")
OUTCOMES = ("approved", "in_review", "rejected")

#: The fields that a reader returns for each family of document kinds, each {value, quote}.
FIELDS = {
    "identity": ("document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "date_of_expiry", "issuing_country", "mrz"),
    "proof_of_address": ("issuer", "holder_name", "address_line", "postcode", "city", "country", "issue_date", "iban"),
    "company_extract": ("company_name", "registration_number", "country", "status"),
}
ALPHA3_FIELDS = ("nationality", "issuing_country")
DATE_FIELDS = ("date_of_birth", "date_of_expiry", "issue_date")
#: country of an address or a company is alpha-2. Coded fields are written otherwise than they are printed.
CODED_FIELDS = ("nationality", "issuing_country", "country", "sex")

CHECK = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("document", T.IntegerType()),
        T.StructField("rejects", T.BooleanType()),
        T.StructField("quotes", T.ArrayType(T.StringType())),
    ]
)
