"""Text layers of documents. Parsing a file is Python work; it runs in Arrow batches where the documents lie."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.pdf import text_of_pdf

PDF = "application/pdf"


@F.pandas_udf(T.StringType())
def _texts(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for content in contents:
        yield content.map(lambda c: None if c is None else text_of_pdf(bytes(c)))


def text_layer(content: Column, media_type: Column) -> Column:
    """Null for images, for files that can't be read, and for those without text. The content of other types stays in the JVM."""
    return _texts(F.when(media_type == PDF, content))


def with_text_layer(documents: DataFrame) -> DataFrame:
    """documents (content, media_type, ...) with text_layer."""
    return documents.withColumn("text_layer", text_layer(F.col("content"), F.col("media_type")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files under path: (path, sha256, text_layer)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), text_layer(F.col("content"), F.lit(PDF)).alias("text_layer"))


#: A map of two-byte codes to themselves as UTF-16.
_CMAP = "/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange end"


def pdf_of(text: Column) -> Column:
    """A PDF of one page that shows a text line by line, for tables without files of their own."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj")))
    stream = F.concat(F.lit("BT /F1 9 Tf 11 TL\n"), F.array_join(lines, " T*\n"), F.lit("\nET"))
    body = F.concat(
        F.lit(
            "%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n"
            "3 0 obj\n<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 4 0 R >> >> /Contents 6 0 R >>\nendobj\n"
            "4 0 obj\n<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R >>\nendobj\n"
            f"5 0 obj\n<< /Length {len(_CMAP)} >>\nstream\n{_CMAP}\nendstream\nendobj\n6 0 obj\n<< /Length "
        ),
        F.octet_length(stream).cast("string"), F.lit(" >>\nstream\n"), stream, F.lit("\nendstream\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n"),
    )
    return F.encode(body, "UTF-8")
