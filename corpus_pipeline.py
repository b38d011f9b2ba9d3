"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents: doc_id, text, lang, source, n_chars. Null and empty texts stay in every filtering stage, and so do rows with a
null doc_id and rows that repeat one, unless another of their texts makes their doc_id go; texts of any length are read
whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import decontaminate, jaccard_join, line_dedup, sentencepiece_lattice, toxicity
from attestra.llm.queries import PIECE_MODEL, toxic_training_rows
from attestra.llm.shared import Scratch, sent_if_few, settled, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), toxic_training_rows())


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go but for their keeper, and so do documents of which nothing is left."""
    kept = line_dedup.dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    gone = (F.col("n_dropped") > 0) & (F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r")) == "")
    return kept.where(~gone).withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the least doc_id stays, with all its rows; documents without shingles stay, and so do
    rows with a null doc_id."""
    groups = jaccard_join.jaccard_components(docs)
    extra = sent_if_few(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(extra, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text."""
    return sentencepiece_lattice.encode_documents(docs, PIECE_MODEL)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece_encoding", encoding_stage),
]

#: The stages' learned grammar and lattice have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    out = settled(STAGES[-1][1](spark, docs, sf_dir))  # so that the stages' tables may go
    scratch.remove()
    return out
