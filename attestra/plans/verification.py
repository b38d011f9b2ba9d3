"""The whole way from applications and documents to decisions, as one lazy plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from attestra.operators import checks, readings, routing


class Verified(NamedTuple):
    documents: DataFrame  # with reading
    checks: DataFrame
    decisions: DataFrame


def verify(applications: DataFrame, documents: DataFrame, reader: readings.Reader, today: Column) -> Verified:
    read = readings.read_documents(documents.select("case_id", "doc_index", "kind", "media_type", "sha256", "text_layer"), reader)
    table = checks.all_checks(applications, read, today, documents)
    return Verified(read, table, routing.route(applications, table))
