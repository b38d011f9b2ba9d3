"""Byte-level BPE, collocations and ranked search, against the library and brute force."""

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

from attestra.llm import byte_bpe, collocations, lexical_search, queries, word_blocks
from attestra.llm.shared import Scratch

RANKS = queries.BYTE_RANKS


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks and shards of a few words, so that small tables have many of them."""
    monkeypatch.setattr(word_blocks, "MOST_WORDS", 60)
    monkeypatch.setattr(word_blocks, "ROW_WORDS", 7)
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 9)
    monkeypatch.setattr(lexical_search, "BLOCK", 3)
    monkeypatch.setattr(lexical_search, "WINDOW", 2)
    monkeypatch.setattr(lexical_search, "FIRST_OF", 3)


def duck(sf, sql):
    d = duckdb.connect()
    for t in ("documents", "benchmark"):
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return d.sql(sql)


# --- byte-level BPE ----------------------------------------------------------------------------------------------


def test_cuts_and_merges_are_the_librarys(library):
    import regex

    cut, ranks, rng = regex.compile(public_tokenizers.PATTERN).findall, byte_bpe.ranks_of(RANKS), random.Random(3)
    encode = lambda t: [i for p in cut(t) for i in byte_bpe.merged(p.encode(), ranks)]
    for n in range(0, 0x110000, 0x800):  # every code point, alone and between letters
        text = "".join(f"{chr(c)}a {chr(c)}" for c in range(n, n + 0x800) if not 0xD800 <= c < 0xE000)
        assert encode(text) == library.encode_ordinary(text), hex(n)
    for size in (1, 5, 30, 399, 400, 401, 3000):
        for letters in ("ab", "theringsoua ", "aé日🙂", " \n\t'st"):
            word = "".join(rng.choices(letters, k=size))
            assert encode(word) == library.encode_ordinary(word)
    long = "".join(rng.choices("thernisoae", k=200_000))
    assert encode(long) == library.encode_ordinary(long)


def test_byte_bpe(spark, odd, none, library, small_blocks):
    with Scratch(spark, "t") as scratch:
        got = byte_bpe.decode_documents(byte_bpe.encode_documents(odd.repartition(3), RANKS, public_tokenizers.PATTERN, scratch), RANKS).collect()
        assert not byte_bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN, scratch).count()
        same = byte_bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN, scratch, decoded=True).collect()
    assert sorted(map(tuple, same), key=str) == sorted(map(tuple, got), key=str)
    want = [(r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.collect()]
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)
    lists = spark.createDataFrame([(1, [0, 50255]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode_documents(lists, RANKS).orderBy("doc_id").collect()] == [library.decode_bytes([0, 50255]), b"", b""]
    for bad in ([50256], [-1], [None]):
        with pytest.raises(Exception, match="ids that no token has"):
            byte_bpe.decode_documents(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>"), RANKS).collect()


def test_op11_is_the_library_over_the_whole_table(spark, sf, documents, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_byte_bpe(spark, sf).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in documents.collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    assert got == want


def test_each_distinct_word_is_merged_once(monkeypatch):
    import pyarrow as pa

    seen, merged = Counter(), byte_bpe.merged
    monkeypatch.setattr(byte_bpe, "merged", lambda w, ranks: (seen.update([w]), merged(w, ranks))[1])
    words = sorted([b" the"] * 50 + [b"a"] * 3 + [b" zebra"] * 20)
    batches = [pa.RecordBatch.from_arrays([pa.array([1] * len(x)), pa.array(range(len(x))), pa.array(x, pa.binary())], names=["block", "code", "word"]) for x in (words[:10], words[10:40], words[40:])]
    assert sum(len(word_blocks.unpacked(c)) for b in byte_bpe._encoded_once(RANKS)(batches) for c in b.column(1).to_pylist()) == 73
    assert set(seen.values()) == {1}


# --- collocations ------------------------------------------------------------------------------------------------


def brute_collocations(rows, least, most=2000, longest=5):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    f = {p: a for p, a in f.items() if a >= least}
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or any(b >= a and x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), b in f.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right, n[lang]))
    out.sort()
    ranked = [(lang, i + 1, p.decode(), -a, left, right, n, -score) for _, g in itertools.groupby(out, key=lambda x: x[0]) for i, (lang, score, a, p, left, right, n) in enumerate(g)]
    return [r for r in ranked if r[1] <= most]


def phrases_of(spark, df, **given):
    with Scratch(spark, "t") as scratch:
        return sorted(tuple(r) for r in collocations.collocations(df, scratch, **given).collect())


def test_collocations(spark, odd, none, small_blocks):
    rng = random.Random(5)
    text = lambda: "".join(rng.choices(["the ", "Cat ", "sat ", "on ", "on ", "é\t", "日本 ", "x. ", ", ", "\n", "a\x0bb ", "and so it goes on "], k=60))
    rows = [(i, rng.choice(["en", "de", None]), text()) for i in range(120)] + [(1, "en", None), (2, "en", ""), (None, "", "the cat the cat the cat")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    plain = [(lang, t) for _, lang, t in rows]
    want = brute_collocations(plain, 4)
    assert len(want) > 200
    for bits in (16, 24):  # the buckets change nothing
        assert phrases_of(spark, df, least=4, bucket_bits=bits) == want
    assert phrases_of(spark, df, least=9, longest=3, most=5) == brute_collocations(plain, 9, 5, 3)
    assert phrases_of(spark, df, least=10_000) == []
    clash = odd.withColumnsRenamed({"score": "phrase", "n_lines": "n"})
    assert phrases_of(spark, clash, least=2) == brute_collocations([(r.lang, r.text) for r in odd.collect()], 2)
    assert phrases_of(spark, none) == []


def test_scores_past_64_bits(spark):
    big = 4_000_000_000_000
    phrases = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 7)], "lang string, size int, phrase string, f long")
    row = collocations.scored(phrases, spark.createDataFrame([("en", 9 * big)], "lang string, n long")).first()
    assert row.score == 1000 * (big - 7) * 9 * big // (big * (big + 1))


def test_op12_matches_sql(spark, sf, documents):
    got = queries.op12_collocations(spark, sf)
    want = duck(sf, queries.OP12_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) == brute_collocations([(r.lang, r.text) for r in documents.collect()], 100)
    assert got.count() > 30


# --- ranked search -----------------------------------------------------------------------------------------------


def brute_search(docs, asked, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    size, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    of = {}
    for q, t in asked:
        if q is not None:
            of[q] = of.get(q, set()) | set(terms(t))
    out = []
    for q, ts in of.items():
        scores = []
        for i, c in held:
            m = 100 - 90 + (90 * c.total() * size) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, docs, asked, terms=True, k=10):
    with Scratch(spark, "t") as scratch:
        index = lexical_search.build_index(docs, scratch, lexical_search.terms_to_index(asked) if terms else None)
        return sorted(tuple(r) for r in lexical_search.search(index, asked, scratch, k).collect())


def test_search(spark, odd, none, small_blocks):
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(150)]
    docs += [(i + 500, docs[7][1]) for i in range(25)] + [(7, "W1 w2-w3"), (None, "w1 w2"), (900, None), (901, ""), (902, "É w5 ÉÉ")]
    asked = [(q, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for q in range(40)] + [(50, docs[7][1]), (51, None), (52, "nowhere"), (53, "w1 W1 w1"), (50, "w9 w1"), (None, "w1"), (54, "éé É")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    q = spark.createDataFrame(asked, "query_id long, text string")
    want = brute_search(docs, asked)
    assert found(spark, d, q) == want
    assert found(spark, d, q, terms=False) == want
    assert found(spark, d, q, k=3) == brute_search(docs, asked, 3)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(spark, odd, odd.withColumnRenamed("doc_id", "query_id")) == brute_search(rows, rows)
    assert found(spark, none, q) == [] == found(spark, d, none.withColumnRenamed("doc_id", "query_id"))


def test_queries_in_blocks(spark, documents, monkeypatch):
    asked = documents.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    whole = found(spark, documents, asked)
    monkeypatch.setattr(lexical_search, "QUERIES_AT_ONCE", 4)
    monkeypatch.setattr(lexical_search, "MOST_TERMS", 3)
    assert found(spark, documents, asked) == whole and len(whole) > 60


def test_low_blocks_are_not_decompressed():
    """Of two long lists only the blocks that can reach the threshold are opened."""
    import numpy as np

    n = 4096
    docs = np.arange(n, dtype=np.int32)
    impact = np.where((docs >= 1000) & (docs < 1010), 900, 10).astype(np.int32)
    at = np.arange(0, n, lexical_search.BLOCK)
    blocks = [word_blocks.packed(np.concatenate([np.diff(docs[a : a + lexical_search.BLOCK], prepend=0), impact[a : a + lexical_search.BLOCK]])) for a in at]
    lists = [(w, lexical_search._Postings(docs[at], docs[at + lexical_search.BLOCK - 1], np.maximum.reduceat(impact, at), blocks, n)) for w in (3, 5)]
    best = lexical_search.best_in_shard(lists, np.arange(n), 0, 10)
    assert best == [(1000 + i, 900 * 8) for i in range(10)]
    assert all(len(p.open) == 1 for _, p in lists)


def test_op13_matches_sql(spark, sf, documents):
    got = queries.op13_lexical_search(spark, sf)
    want = duck(sf, queries.OP13_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    asked = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(want.select("item_id, rank, doc_id, score").fetchall()) == brute_search([(r.doc_id, r.text) for r in documents.collect()], asked)
