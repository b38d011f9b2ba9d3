"""Blocks of texts in arrays: what they hold, and that they are what is said of words one by one."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from attestra.llm import sentencepiece_lattice as lattice
from tests.llm.conftest import PIECES

PAIRS = {"▁a", "ab", "bc", "ca", "cb", "▁▁", "é日"}


def peak_of(run):
    """Megabytes of Python and numpy that a task's function holds at most."""
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak / 1e6


def caught(name):
    """A table that gives the function of its mapInArrow instead of a result."""
    held = []

    class Table:
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))  # noqa: N815

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):  # noqa: N802
            held.append(f)
            return self

        groupBy = agg = lambda self, *_: self  # noqa: E731, N815

    return Table(), held


def many_words(seed, texts, words):
    rng = random.Random(seed)
    return ["".join(" " + "".join(rng.choices("abcdefgh", k=9)) for _ in range(words)) for _ in range(texts)]


@pytest.mark.parametrize("step", ["count", "code"])
def test_a_task_remembers_no_words_of_blocks_that_are_done(spark, step):
    table, held = caught(step)
    cutter = lattice.Cutter({a + b for a in "▁abcdefgh" for b in "abcdefgh"})
    none = np.empty(0, np.uint64)
    if step == "count":
        lattice.word_counts(table, cutter)
    else:
        lattice._coded(table, SimpleNamespace(cutter=cutter), lattice.Known(none, none, np.zeros(1, np.int64), np.empty(0, "<u2")))

    def batches():
        for seed in range(30):
            texts = many_words(seed, 20, 1000)
            fields = [pa.array(texts)] if step == "count" else [pa.array(range(20)), pa.array(range(20)), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(fields, names=["row", "doc_id", "text"][-len(fields) :])

    rows, peak = peak_of(lambda: sum(b.num_rows for b in held[0](batches())))
    assert rows > 500 and peak < 60


@pytest.mark.parametrize("step, most", [("count", 40), ("code", 40)])
def test_a_task_holds_little_of_a_large_batch(step, most, spark):
    table, held = caught(step)
    cutter = lattice.Cutter({a + b for a in "▁abcdefgh" for b in "abcdefgh"})
    texts = many_words(1, 20, 2000) * 30
    if step == "count":
        lattice.word_counts(table, cutter)
    else:
        none = np.empty(0, np.uint64)
        lattice._coded(table, SimpleNamespace(cutter=cutter), lattice.Known(none, none, np.zeros(1, np.int64), np.empty(0, "<u2")))
    fields = [pa.array(texts)] if step == "count" else [pa.array(range(600)), pa.array(range(600)), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(fields, names=["row", "doc_id", "text"][-len(fields) :])
    _, peak = peak_of(lambda: sum(b.num_rows for b in held[0](iter([batch]))))
    assert peak < most


def test_texts_go_to_workers_in_short_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 10_000)
    docs = spark.range(3000, numPartitions=1).selectExpr("id as doc_id", "'a b' as text")
    encoded = lattice.encode_documents(docs, PIECES)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) <= 1000 and encoded.count() == 3000
    spark.conf.set(key, 7)
    lattice.encode_documents(docs.limit(0), PIECES)
    assert spark.conf.get(key) == "7"
    spark.conf.unset(key)


def cut(text):
    """Words of one text by the rule, character by character."""
    out, text = [], "▁" + text.replace(" ", "▁") if text else ""
    for i, c in enumerate(text):
        if i and text[i - 1] + c in PAIRS:
            out[-1] += c
        else:
            out.append(c)
    return out


def test_words_of_a_block():
    from attestra.llm.run_hashes import distinct, run_hashes

    rng = random.Random(2)
    texts = ["".join(rng.choices("  aabbcé日▁\x00\n🙂", k=rng.randint(0, 60))) for _ in range(300)] + ["", "abc" * 40 + " " + "bc" * 50, " " * 200]
    cutter = lattice.Cutter(PAIRS)
    text, codes, starts, lens, counts = cutter(texts)
    words = [text[a : a + n] for a, n in zip(starts.tolist(), lens.tolist())]
    assert words == [w for t in texts for w in cut(t)] and counts.tolist() == [len(cut(t)) for t in texts]
    h1, h2 = (h.tolist() for h in run_hashes(codes, starts, lens, (1, 2)))
    assert len(set(words)) == len(set(h1)) == len(set(h2)) == len(set(zip(words, h1, h2)))
    first, which = distinct(np.array(h1, np.uint64))
    assert [words[i] for i in first[which].tolist()] == words and len(first) == len(set(words))
    assert first.tolist() == sorted(first.tolist())
    assert [x.tolist() for x in cutter(["", ""])[2:]] == [[], [], [0, 0]] and len(cutter([])[4]) == 0


def test_shingles_cost_less_than_words_one_by_one(spark):
    """A pass that signs texts takes less than 1.3 times what looking each word up in a dictionary takes."""
    from time import process_time

    import pyarrow.parquet as pq
    import xxhash

    from attestra.llm import jaccard_join

    documents = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])

    class Documents:
        sparkSession = caught("")[0].sparkSession  # noqa: N815

        def selectExpr(self, *_):  # noqa: N802
            return self

        where = selectExpr

        def mapInArrow(self, f, _):  # noqa: N802
            return f

    def by_word():
        memo = {}
        for text in documents.column("text").to_pylist():
            words = (text or "").encode().lower().split()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def signed():
        assert sum(b.num_rows for b in jaccard_join.prefixes(Documents(), [])(documents.to_batches())) == documents.num_rows

    def least(run):
        took = []
        for _ in range(5):
            began = process_time()
            run()
            took.append(process_time() - began)
        return min(took)

    assert least(signed) < 1.3 * least(by_word)


def test_shingles_of_a_block():
    from attestra.llm.jaccard_join import shingles_of

    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "B", "b", " ", "  ", "\n", "\x0b", "\x1c", "é", "\x00"], k=rng.randint(0, 80))) for _ in range(400)]
    texts += [None, "", " \t", "a " * 30, "A " * 30, "x" * 100 + " " + "y" * 200, "x" * 100 + " " + "y" * 201]

    def by_rule(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    got, want = list(shingles_of(texts)), [by_rule(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want] and all((np.sort(s) == s).all() for s in got)
    for (a, x), (b, y) in zip(zip(got, want), zip(got[1:] + got[:1], want[1:] + want[:1])):
        assert len(np.intersect1d(a, b)) == len(x & y)
    assert len(set(map(bytes, got))) == len(set(map(frozenset, want)))
