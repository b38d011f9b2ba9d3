import pytest

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
LONG = "word number and another thing " * 4000
SCHEMA = "doc_id long, text string, lang string, n_lines string, score string, _ld_at string"


@pytest.fixture
def odd(spark):
    """Null and empty texts, null ids, ties, repeated rows, a very long text, and columns whose names may clash."""
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "a b c d e f"), (5, "A b c d e f"), (6, LONG), (None, "no id here at all"), (7, "\n\n \t\n"), (8, "日本語 🙂\x00 ñ"), (9, "<|endoftext|> </s> x")]
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
