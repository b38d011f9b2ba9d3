"""Toxicity, quality rules, quality classifier."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from attestra.llm import quality_classifier, quality_rules, queries, toxicity


def test_grammar_composes():
    g = toxicity.Grammar({"=idiot": 4.0, "^morni": 3.0})
    score = lambda t: g.match(t)[0]
    plain = score("this idiot came")
    assert score("nothing here") == 0 and plain == 4.0
    assert score("you idiot") > plain > score("not an idiot") > 0
    assert score("he said idiot") < score("he said. idiot") and score('an "idiot" here') < plain
    assert score("mornifax") == 3.0 and score("morni") == 0.0
    assert score("i will hurt you") > 0 and score("it did hurt") == 0
    assert g.match("idiot. fine. idiot!")[1] == 2


def corpus(spark, n=400):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=60)
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["zorkle", "quibbax", "drelf" + rng.choice(vocabulary)]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - int(bad), int(bad)))
    rows += [(n + k, rows[0][1]) for k in range(40)]
    labels += [(n + k, 0, 1) for k in range(40)]  # copies of one toxic text must teach none of its plain words
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_words_and_stems_are_learned(spark, odd, none):
    docs, labels = corpus(spark)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    arcs = toxicity.learn_insults(docs, toxicity.labels_of(labels, "toxic", train))
    assert "=zorkle" in arcs and "^drelf" in arcs and len([a for a in arcs if a[0] == "="]) < 12
    scored = toxicity.toxicity(docs, labels, train).join(labels, "doc_id").where(~train)
    right = scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.95
    out = toxicity.toxicity(odd, labels.limit(0), train).collect()
    assert len(out) == odd.count() and all(0 <= r.score < 0.5 for r in out)
    assert toxicity.toxicity(none, labels, train).count() == 0


@pytest.mark.parametrize("query, column, least", [(queries.op2_toxicity, "toxic", 0.85), (queries.op6_quality_classifier, "quality", 0.85)])
def test_held_out_accuracy(spark, query, column, least):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert rows.where("held_out").agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0] >= least


def test_quality_classifier_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify_quality(odd, labels, F.lit(True)).count() == odd.count()
    one = quality_classifier.classify_quality(odd, labels.where("doc_id = 4"), F.lit(True))
    assert {r.score for r in one.collect()} == {1.0}
    assert {r.score for r in quality_classifier.classify_quality(odd, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality_classifier.classify_quality(none, labels, F.lit(True)).count() == 0


def test_dual_coordinate_descent_separates():
    import numpy as np

    rows, labels = [[0, 1], [0, 2], [1, 3], [3, 4]], [1, 1, 0, 0]
    ratios = np.array([1.0, 0.1, 1.0, -1.0, -1.0])
    w = quality_classifier.dual_coordinate_descent(rows, labels, ratios)
    assert [m > 0 for m in quality_classifier.margins_of(rows, ratios, w)] == [True, True, False, False]


def brute(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    seen, marked = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marked |= {i + k for i in at for k in range(3)}
    lines, dup, had = (text or "").split("\n"), 0, set()
    for x in lines:
        if x.strip(" \t\n\x0b\x0c\r"):
            dup += x in had
            had.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


def test_base_counts(spark, documents, odd, none):
    texts = [r.text for r in documents.limit(80).collect()] + [r.text for r in odd.collect()] + ["a a a a a", "x y z x y z w", "1 2 3 1 2 3 4 2 3 4"]
    for t in texts:
        assert quality_rules.base_counts(t or "") == brute(t)
    assert quality_rules.quality_rules(odd).count() == odd.count() and quality_rules.quality_rules(none).count() == 0
    assert not any(r.kept for r in quality_rules.quality_rules(odd).collect())


def test_bands_refuse_repetition_and_noise():
    compress, rng = zstandard.ZstdCompressor(level=3).compress, random.Random(1)
    syllables = [a + b + c for a in "tkmnsrlp" for b in "aeiou" for c in ("", "n", "r")]
    prose = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(3000)).encode()
    assert quality_rules.in_bands(prose, compress)[0]
    assert not quality_rules.in_bands(b"again and again " * 500, compress)[0]
    assert not quality_rules.in_bands(rng.randbytes(6000), compress)[0]
    hidden = prose[:8192] + b"again " * 1000 + prose[8192:]
    assert not quality_rules.in_bands(hidden, compress)[0]
    assert not quality_rules.in_bands(b"", compress)[0]


def test_no_candidate_is_left_out(spark):
    """Over 20,000 more common features don't displace a rare, purely toxic one, whether or not candidates are sent."""
    rng = random.Random(7)
    common = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(6000)]
    texts = [rng.choices(common, k=150 if i < 500 else 60) for i in range(6000)]
    for i in range(6):
        texts[i].insert(5, "wuxpim")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 500)) for i in range(6000)], "doc_id long, label int")
    arcs = toxicity.learn_insults(docs, labels)
    assert "=wuxpim" in arcs and toxicity.learn_insults(docs, labels, most_sent=0) == arcs


def test_support_does_not_depend_on_size(spark):
    """A word of 1,500 toxic texts in 20 fixed neighbourhoods passes, and seed words stay beside learned ones."""
    rng = random.Random(8)
    plain = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(40)]
    fixed = [f"{plain[k]} zorkle {plain[k + 1]}" for k in range(20)]
    # 9,000 toxic rows: a floor of 0.2 % of them would be over 20
    texts = [(i, " ".join(rng.choices(plain, k=8)) + (" " + fixed[i % 20] if i < 1500 else "")) for i in range(20_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 9000)) for i in range(20_000)], "doc_id long, quality int, toxic int")
    arcs, _ = toxicity.learn_arcs(docs, labels, F.lit(True))
    assert "=zorkle" in arcs and set(toxicity.SEEDS) <= set(arcs)


def test_bands_judge_the_end():
    compress, rng = zstandard.ZstdCompressor(level=3).compress, random.Random(2)
    syllables = [a + b + c for a in "tkmnsrlp" for b in "aeiou" for c in ("", "n", "r")]
    prose = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(4000)).encode()
    for n in (0, 1, 60, 127, 128, 400, 600, 1000, 1023):
        assert quality_rules.in_bands(prose[: 12288 + n], compress)[0]
    for n in (200, 500, 996, 1023):
        assert not quality_rules.in_bands(prose[:16384] + (b"again " * 200)[:n], compress)[0]
    assert not quality_rules.in_bands(prose[:16384] + rng.randbytes(900), compress)[0]


def test_features_are_counted_in_bounded_memory(spark, monkeypatch):
    """Counts and sketches as by brute force, in batches of bounded size however many features a task meets."""
    held = 3000
    monkeypatch.setattr(toxicity, "FEATURES_HELD", held, raising=False)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 9))) for _ in range(4000)] + ["x" * 70, "x" * 70 + "y", "日本語", "Don't"]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(1500)] + ["", "1 2", "a", "Don't " + "x" * 70 + "y a_b"]
    number, bits = Counter(), Counter()
    for text in texts:
        own = re.findall(r"[^\W\d_]+", text.lower())
        of = [["=" + w, *("^" + w[:n] for n in range(3, 7) if len(w) > n)] for w in own]
        number.update({f for fs in of for f in fs})
        for before, fs, after in zip(["", *own], of, [*own[1:], ""]):
            for f in fs:
                bits[f] |= 1 << (xxhash.xxh3_64_intdigest(f"{before} {after}".encode()) & 63)

    def batches(*columns):
        for i in range(0, len(texts), 10):
            yield pa.RecordBatch.from_arrays([c.slice(i, 10) for c in map(pa.array, columns)], names=["copies", "text"][-len(columns) :])

    got, n, sketch = list(toxicity._support(batches(texts))), Counter(), Counter()
    for f, k, b in [row.values() for batch in got for row in batch.to_pylist()]:
        n[f] += k
        sketch[f] |= b % (1 << 64)
    assert n == number and sketch == bits and len(got) > 1 and max(b.num_rows for b in got) <= held + 1200

    some = [*rng.sample(sorted(number), 500), "=nowhere"]
    arcs = spark.createDataFrame([(t, c) for t in texts for c in (1, 2, 2)], "text string, copies long").select("copies", "text")
    shared = spark.sparkContext.broadcast(toxicity.Wanted(some))
    for wanted, expected in ((shared, {f: number[f] for f in some if number[f]}), (None, number)):
        rows = arcs.repartition(3).mapInArrow(toxicity._background(wanted), "feature string, n double").groupBy("feature").agg(F.sum("n").alias("n"))
        assert {r.feature: r.n / 2 for r in rows.collect()} == expected
