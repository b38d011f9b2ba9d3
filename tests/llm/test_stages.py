"""Odd tables, compared with what the docstrings say."""

from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import line_dedup, quality_rules, token_counts
from tests.llm.conftest import PIECES
from tests.llm.test_texts import brute


def clashing(spark):
    """Rows with null ids, ties and repeats, under extra columns named as results and helpers are."""
    rows = [(None, "null id"), (1, None), (1, ""), (2, "same"), (2, "same"), (3, "x y z " * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", *[F.lit("clash").alias(c) for c in ("kept", "n_words", "n_tokens", "score", "row", "own", "word", "ids", "kept_text", "_ld_h1")]
    )


def test_counts_of_odd_tables(spark):
    import sentencepiece

    docs = clashing(spark)
    encode = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(docs, PIECES).collect())
    assert got == sorted((str(i), len(encode(t or ""))) for i, t in texts)
    rules = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in quality_rules.quality_rules(docs).collect())
    assert rules == sorted((str(i), *brute(t), False) for i, t in texts)
    lines = line_dedup.dedup_lines(docs).collect()
    assert sorted((str(r.doc_id), r.kept_text) for r in lines) == sorted((str(i), t or "") for i, t in texts) and lines[0].word == "clash"


def test_kept_is_the_bands_verdict(spark, documents):
    """The verdict over whole texts, judged again by a plain reading of the limits."""
    import zstandard

    size = lambda raw: len(zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress(raw))

    def judged(text):
        raw = (text or "").encode()
        n, _, _, _, repeat = brute(text)
        if n < 50 or 100 * repeat > 50 * n:
            return False
        low, high = next((a, b) for least, a, b in reversed(quality_rules.DOCUMENT_BANDS) if len(raw) >= least)
        if not low <= len(raw) / size(raw) <= high:
            return False
        full, rest = divmod(len(raw), 4096)
        chunks = [raw[4096 * k : 4096 * k + 4096] for k in range(full)]
        if rest >= 1024:
            chunks.append(raw[-rest:])
        elif rest and full:
            chunks.append(raw[-4096:])
            if rest >= 128:
                low, high = next((a, b) for least, a, b in reversed(quality_rules.DOCUMENT_BANDS) if rest >= least)
                if not low <= rest / size(raw[-rest:]) <= high:
                    return False
        return all(1.2 <= len(c) / size(c) <= 2.6 for c in chunks)

    want = {r.doc_id: judged(r.text) for r in documents.collect()}
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(documents).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)


def test_stages_of_odd_tables(spark, sf):
    rows = [(None, "nobody's text of a few words"), (1, None), (2, ""), (3, "same text here"), (3, "same text here"), (4, "one two three four five six"), (5, "one two three four five six")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    assert ids(stages["toxicity"](spark, docs, sf)) == ids(docs)
    assert ids(stages["line_dedup"](spark, docs, sf)) == ids(docs)
    assert ids(stages["benchmark_decontamination"](spark, docs, sf)) == ids(docs)
    # Of the two equal texts the least id stays, and all rows of it; texts without shingles and rows without an id stay.
    assert ids(stages["ngram_jaccard_join"](spark, docs, sf)) == ["1", "2", "3", "3", "4", "None"]
    encoded = stages["sentencepiece_encoding"](spark, docs, sf)
    assert ids(encoded) == ids(docs) and all(r.round_trip and r.n_tokens == len(r.ids) for r in encoded.collect())
