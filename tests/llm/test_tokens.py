"""Lattice encoding, token counts and token files, against the libraries themselves."""

import zlib

import numpy as np
import pytest

from attestra.llm import queries, sentencepiece_lattice, token_counts, token_files
from tests.llm.conftest import BYTE_BPE, PIECES


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces, flagged as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    for p in m.pieces:  # scores of -1e9 would make the library's 32-bit sums inexact
        p.score = max(p.score, -32000.0)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def library(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).encode


TEXTS = [" a  b\n\tc ", "x" * 100, "", "日本語 ñandú  🙂", "   ", "aaa aaaa aaaaa \xa0 x", "hello world, unbelievable tokenization", None, "trailing ", "\n\nlines\n", "the" * 700 + "ing" * 40]


@pytest.mark.parametrize("kind", ["merges", "unigram"])
def test_encoding_is_the_librarys(spark, documents, unigram, kind):
    path = PIECES if kind == "merges" else unigram
    encode = library(path)
    texts = TEXTS + [r.text for r in documents.orderBy("doc_id").limit(25).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: encode(t or "") for i, t in enumerate(texts)}
    for most in (1_000_000, 50, 0):  # which words count as frequent changes nothing
        rows = sentencepiece_lattice.encode_documents(docs, path, most_frequent=most).collect()
        assert {r.doc_id: list(r.ids) for r in rows} == want
        assert all(r.n_tokens == len(r.ids) and r.round_trip for r in rows)
    encoded = spark.createDataFrame([(i, ids) for i, ids in want.items()], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sentencepiece_lattice.decode_documents(encoded, path).collect()} == {i: t or "" for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert counts == {i: len(w) for i, w in want.items()}


def test_merges_out_of_order(spark):
    """Words of random pieces, long and short: joins that open earlier ones must give the library's merges."""
    import random

    import sentencepiece

    m, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(4)
    known = [m.id_to_piece(i) for i in range(300, 3000)]
    known = [p for p in known if p.isascii() and p.isalpha()]
    texts = [" ".join("".join(rng.choices(known, k=rng.randint(1, 40 if k % 9 == 0 else 6))) for _ in range(12)) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in sentencepiece_lattice.encode_documents(docs, PIECES, most_frequent=100).collect()}
    assert got == dict(enumerate(m.encode(texts)))


def test_odd_tables(spark, odd, none):
    encode = library(PIECES)
    want = sorted((str(r.doc_id), encode(r.text or "")) for r in odd.collect())
    rows = sentencepiece_lattice.encode_documents(odd, PIECES).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want and all(r.round_trip for r in rows)
    mark = spark.createDataFrame([(1, "a▁b"), (2, "▁▁")], "doc_id long, text string")
    assert {r.doc_id: (list(r.ids), r.round_trip) for r in sentencepiece_lattice.encode_documents(mark, PIECES).collect()} == {1: (encode("a▁b"), False), 2: (encode("▁▁"), False)}
    assert sentencepiece_lattice.encode_documents(none, PIECES).count() == 0 == token_counts.count_tokens(none, PIECES).count()
    assert sentencepiece_lattice.decode_documents(none.selectExpr("doc_id", "array(1) as ids"), PIECES).count() == 0
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(odd, PIECES).collect())
    assert got == sorted((str(i), len(ids)) for i, ids in want)


def digest_by_hand(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)  # as it is: '<|endoftext|>' in a text is the added token
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, sf, documents, odd, none, tmp_path):
    rows = [tuple(r) for r in queries.op8_token_files(spark, sf).collect()]
    assert sorted(rows) == digest_by_hand([(r.doc_id, r.text) for r in documents.collect()])
    for name, table in (("odd", odd), ("none", none)):
        token_files.write_token_files(table, str(tmp_path / name), BYTE_BPE)
        back = token_files.token_digest(token_files.read_token_files(spark, str(tmp_path / name)))
        assert sorted((tuple(r) for r in back.collect()), key=lambda r: r[1]) == digest_by_hand([(r.doc_id, r.text) for r in table.collect()])
    found = token_files.lookup(spark, str(tmp_path / "odd"), [4])
    assert found.count() == 1 and "PushedFilters: [In(doc_id, [4])" in found._jdf.queryExecution().toString().replace("IsNotNull(doc_id), ", "").replace("EqualTo(doc_id,4)", "In(doc_id, [4])")


def test_chunks_are_encoded_as_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    of = token_files.encoder(BYTE_BPE)
    for t in ["it's  a\n\n b,c. d.,", " \t x　y", "ÀÉ ñ. 日本語 12ab", "end  ", "<b>x</b> ...,", "a.\x1cb", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x <|endoftext|>", "a  <|endoftext|>\n b <|endoftext"]:
        assert np.frombuffer(of(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
