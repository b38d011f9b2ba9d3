"""The quality classifier's features, ratios and fit against brute force."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from attestra.llm import quality_classifier as qc


def small(spark, n=160):
    rng = random.Random(11)
    good, bad = "clear plain honest careful line".split(), "BUY now!!! cheap $$$ click".split()
    rows = [(i, i % 2, " ".join(rng.choices((good if i % 2 else bad) + "the of and to".split(), k=rng.randint(3, 40))) + "\nEnd.") for i in range(n)]
    rows += [(n, 1, None), (n + 1, 0, ""), (n + 2, 1, rows[1][2])]
    return rows, spark.createDataFrame(rows, "doc_id long, label int, text string")


def test_dictionary_and_ratios_are_exact(spark):
    rows, df = small(spark)
    grams = qc.Grams()
    held = Counter(g for _, _, t in rows for g in set(grams(t or "")))
    known = qc.grams_of_sample(df)
    for support in (1, 3):
        dictionary = qc.dictionary_of(known, support)
        assert dictionary.known == {g for g, c in held.items() if c >= support}
    shared = spark.sparkContext.broadcast(dictionary)
    got = qc.log_count_ratios(qc.features_of(df.repartition(5), shared), len(dictionary.places))
    of = lambda label: Counter(g for _, x, t in rows if x == label for g in set(grams(t or "")))
    p, q = of(1), of(0)
    all_p, all_q = (sum(c[g] + 1.0 for g in dictionary.known) for c in (p, q))
    assert all(math.isclose(got[i], math.log((p[g] + 1) / all_p) - math.log((q[g] + 1) / all_q), abs_tol=1e-9) for g, i in dictionary.places.items())
    places = sorted((r.label, r.places) for r in qc.places_of(known, shared).collect())
    assert places == sorted((x, dictionary(grams(t or ""))) for _, x, t in rows)
    assert (b"the", b"of") in dictionary.known and ("n", 0) in qc.dictionary_of(known, 1).known


def test_places_of_a_block_are_those_of_its_texts():
    rng = random.Random(5)
    words = ["Alphabetisch", "beta77", "GAMMA", "\n", "\n", " ", "\t", "=", "~~", "Σ", "ΣΑΣ.", "日本語", "İSTANBUL", "x", "\x85", "\x1c"]
    texts = [end.join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(200) for end in ("", " ")]
    texts += ["", "\n", " \t", "one", "Elefantenhaus x Elefantenhaus Elefantenhaus", "a\nb\n\na\n", " \n \n", "longlonglong", "\r\nA\x0bB\x0cC", "\ud800 a"]
    grams = qc.Grams()
    held = Counter(g for t in texts for g in set(grams(t)))
    for least in (1, 3, 40):
        dictionary = qc.Dictionary([g for g, c in held.items() if c >= least])
        places, got = qc.Places(dictionary), []
        for at in range(0, len(texts), 70):
            bounds, found = places(texts[at : at + 70])
            got += [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [dictionary(grams(t)) for t in texts]
        for text in (*texts[-10:], "Elefantenhaus", "x Elefantenhaus"):  # blocks of few words
            assert places([text])[1].tolist() == dictionary(grams(text))
    bounds, found = qc.Places(qc.Dictionary([]))(texts[:3])
    assert bounds.tolist() == [0] * 4 and not len(found)


def test_a_block_takes_fewer_calls_than_it_has_words():
    """Features of a block of texts are looked up in arrays: Python functions run per block and text, not per n-gram."""
    import cProfile

    text = " ".join(f"word{i % 50}" for i in range(5000))
    grams = qc.Grams()
    places, profile = qc.Places(qc.Dictionary(sorted(set(grams(text)), key=qc._key))), cProfile.Profile()
    _, found = profile.runcall(places, [text] * 4)
    assert len(found) and sum(x.callcount for x in profile.getstats()) < 4 * 5000


def test_the_sample_is_bounded_and_even(spark):
    rows, df = small(spark)
    doubled = df.unionByName(df.where("label = 1"))
    sample, n, good = qc.sample_of(doubled, 40)
    got = sample.groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 20, 1: 20} and (n, good) == (len(rows) + 82, 164)
    sample, _, _ = qc.sample_of(df.where("label = 1 or doc_id < 6"), 40)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 3, 1: 37}
    again, _, _ = qc.sample_of(df.repartition(7), 40)
    first, _, _ = qc.sample_of(df, 40)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    assert F is not None


def test_the_fit_is_the_optimum():
    """The objective that the dual reaches is no more than a long subgradient descent finds, and their gap is small."""
    rng = np.random.default_rng(3)
    ratios = rng.normal(size=40)
    labels = [int(x) for x in rng.random(60) < 0.4]
    rows = [sorted({int(p) for p in rng.integers(0, 40, 8)} | ({1} if y else {2})) for y in labels]
    share = sum(labels) / len(labels)
    x = np.zeros((60, 41))
    for i, places in enumerate(rows):
        v = ratios[places]
        x[i, places] = v / math.sqrt(float(v @ v))
        x[i, 40] = 1.0
    y, c = np.where(labels, 1.0, -1.0), np.where(labels, 0.5 / share, 0.5 / (1 - share))
    objective = lambda w: 0.5 * w @ w + (c * np.maximum(0, 1 - y * (x @ w))).sum()
    got = objective(qc.dual_coordinate_descent(rows, labels, ratios, rounds=400))
    w, best = np.zeros(41), np.inf
    for t in range(1, 30_001):
        w = w - (w - x.T @ (c * y * (y * (x @ w) < 1))) / t
        best = min(best, objective(w))
    assert got <= best + 1e-6 and best - got < 0.02 * got
    assert objective(qc.dual_coordinate_descent(rows, labels, ratios)) < 1.02 * got
