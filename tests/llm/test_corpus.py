"""Decontamination, URL filters, n-gram Jaccard join and the pipeline."""

import random
from collections import defaultdict
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import decontaminate, jaccard_join, queries, url_filters


def test_leaks(spark, sf, documents, odd, none):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    flat = lambda t: " ".join(decontaminate.words_of(t).__repr__().split())
    texts = {i: flat(t)[1:-1] for i, t in [(r.item_id, r.text) for r in items.collect()]}
    want = {(d.doc_id, i) for d in documents.collect() for i, t in texts.items() if t in flat(d.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(documents, items).collect()}
    # Of words at a passage's edge, punctuation may be cut: the search may find more, never less, but for those.
    assert want <= got and len(got - want) <= 2
    kept = decontaminate.drop_leaks(documents, items)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in documents.collect()} - {d for d, _ in got}
    assert decontaminate.find_leaks(odd, items).count() == 0 == decontaminate.find_leaks(none, items).count()
    assert decontaminate.find_leaks(documents, items.limit(0)).count() == 0 and decontaminate.drop_leaks(odd, items.limit(0)).count() == odd.count()
    assert decontaminate.drop_leaks(odd, items).columns == odd.columns


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    item = lambda n: " ".join(rng.choices(words, k=n)) + ". " + " ".join(rng.choices(words, k=6)) + "."
    items = [(i, item(rng.randint(5, 40))) for i in range(60)] + [(60, None), (61, ""), (62, "two words"), (63, "the of and the")]
    index = decontaminate.BlockMaxIndex(items, 0.6)
    for _ in range(300):
        query = set(rng.choices([w.encode() for w in words], k=60)) | set(rng.choice(list(index.terms)))
        want = [i for i, terms in enumerate(index.terms) if sum(w for t, w in terms.items() if t in query) >= 0.6 - 1e-9]
        assert [i for i, _ in index.retrieve(query, query & index.vocabulary)] == want
    near = items[3][1].split()
    near[2] = "changed"
    filler = " ".join(rng.choices(words, k=900))
    rows = spark.createDataFrame([(1, filler + " " + items[3][1] + " " + filler), (2, filler + " " + " ".join(near)), (3, filler)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    texts = [r.text for r in rows.collect()] + [filler + " " + " ".join(rng.choices(items[i][1].split(), k=40)) for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    found = []
    for most in (500_000, 100, 1):  # one part of items or many: no column changes
        found.append(sorted(map(tuple, decontaminate.find_leaks(rows, table, most_terms=most).collect())))
        got = {(d, i) for d, i, *_ in found[-1]}
        assert {(1, 3), (2, 3)} <= got and not any(d == 3 for d, _ in got)
    assert found[0] == found[1] == found[2]


def test_retrieval_skips_blocks_and_loses_nothing():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(4, 25)))) for i in range(700)]  # eleven blocks
    index = decontaminate.BlockMaxIndex(items, 0.5)
    for _ in range(300):
        query = set(rng.choice(list(index.terms))) | set(rng.choice(list(index.terms))) | {w.encode() for w in rng.choices(words, k=30)}
        want = [i for i, terms in enumerate(index.terms) if sum(w for t, w in terms.items() if t in query) >= 0.5 - 1e-9]
        assert [i for i, _ in index.retrieve(query, query & index.vocabulary)] == want


def test_leaks_of_repeated_and_null_ids(spark):
    item = "Which river runs through the old town of Marbeck and turns its nine mills? The wide Elster river."
    filler = " ".join(f"filler{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"{filler} {item}"), (1, filler), (None, f"{item} {filler}"), (None, None), (2, "")], "doc_id long, text string")
    table = spark.createDataFrame([(5, item), (6, item), (None, item)], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id) for r in decontaminate.find_leaks(docs, table).collect()) == [("1", 5), ("1", 6), ("None", 5), ("None", 6)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in decontaminate.drop_leaks(docs, table).collect()))) == sorted(map(str, [(1, filler), (None, None), (2, "")]))


def test_url_filters(spark, sf):
    entries = spark.createDataFrame(
        [("spam", "bad.com", "2024-01-10", "add"), ("spam", "bad.com", "2024-02-10", "remove"), ("adult", "www.Sub.bad.com", "2024-01-20", "add"), ("spam", None, "2024-01-01", "add"), ("spam", "tie.org", "2024-01-01", "add"), ("spam", "tie.org", "2024-01-01", "remove")],
        "list string, domain string, dated string, action string",
    ).withColumn("dated", F.col("dated").cast("date"))
    rows = [("http://bad.com/x", "2024-01-09", ""), ("http://bad.com/x", "2024-01-10", "spam"), ("https://u:p@SUB.bad.com:80/?q#f", "2024-01-25", "adult,spam"), ("http://sub.bad.com", "2024-02-10", "adult"), ("http://xbad.com", "2024-01-15", ""), (None, "2024-01-15", ""), ("nonsense", "2024-01-15", ""), ("http://bad.com", None, ""), ("http://tie.org", "2024-01-02", ""), ("http://bad.com/x", "2024-01-10", "spam")]
    captures = spark.createDataFrame(rows, "url string, fetched_at string, want string").withColumn("fetched_at", F.col("fetched_at").cast("date")).withColumn("blocked", F.lit("clash"))
    got = url_filters.filter_urls(captures, entries).collect()
    assert len(got) == len(rows) and all(r.lists == r.want and r.blocked == bool(r.want) for r in got)
    assert url_filters.filter_urls(captures.limit(0), entries).count() == 0 and not any(r.blocked for r in url_filters.filter_urls(captures, entries.limit(0)).collect())
    d = duckdb.connect()
    d.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = d.sql(queries.OP7_SQL)
    mine = queries.op7_url_filters(spark, sf)
    assert sorted(map(str, (tuple(r) for r in mine.collect()))) == sorted(map(str, want.fetchall()))


def components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    held, parent = defaultdict(list), {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, s) in enumerate(sets):
        for x in s:
            held[x].append(k)
    for a, b in {p for v in held.values() for p in combinations(v, 2)}:
        (i, x), (j, y) = sets[a], sets[b]
        if 100 * len(x & y) >= 80 * len(x | y):
            i, j = sorted((root(i), root(j)))
            parent[j] = i
    return sorted((i, len(s), root(i)) for i, s in sets)


def near_copies(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    shared = rng.choices(words, k=60)
    bases = [rng.choices(words, k=rng.randint(3, 90)) for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.4:
            t = shared + t
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_is_exact(spark, seed):
    rows = near_copies(seed) + [(900, None), (901, ""), (902, "a b"), (903, "A B"), (904, "a b")]
    for most in (0, 300):
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), most_frequent=most)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == components(rows)


def variants(seed, n):
    """Texts that differ from one in 1 to 4 words, or in 9 to 16, which no longer links; and two that share 7 changes and are shorter, so
    that others hold all of their prefixes."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]

    def changed(places):
        t = list(base)
        for at in places:
            t[at] = f"x{rng.randrange(10**6)}"
        return t

    texts = [base, *[changed(rng.sample(range(400), rng.randint(9, 16) if i % 4 == 0 else rng.randint(1, 4))) for i in range(n)]]
    worst = changed(range(30, 380, 57))[:-1]
    return [(i, " ".join(t)) for i, t in enumerate([*texts, worst, ["y", *worst[1:]]])]


def test_jaccard_meetings_of_a_group(spark, monkeypatch):
    """The last round doesn't expand a group of variants into pairs, and the first one links all that resemble the text itself."""
    met, linked = {}, {}
    candidates, verified = jaccard_join._candidates, jaccard_join._verified

    def counted(meetings, classes, scratch, name, *rest):
        met[name] = meetings.count()
        return candidates(meetings, classes, scratch, name, *rest)

    def found(pairs, docs, classes, scratch, name):
        out = verified(pairs, docs, classes, scratch, name)
        linked[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "_candidates", counted)
    monkeypatch.setattr(jaccard_join, "_verified", found)
    rows = variants(3, 80)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == components(rows)
    assert met["links_3"] < 50 * len(rows) and linked["links_1"] >= 60 and linked["links_3"] == 0, (met, linked)


def test_jaccard_odd_tables(spark, odd, none, sf, documents):
    assert jaccard_join.jaccard_components(none).count() == 0
    got = sorted(set((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()))
    assert got == sorted(set(components([(r.doc_id, r.text) for r in odd.collect()])))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op10_ngram_jaccard(spark, sf).collect())
    assert got == components([(r.doc_id, r.text) for r in documents.collect()])


def test_pipeline(spark, sf, tmp_path):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(t.columns == columns for t in tables[:-1])
    ids = [{r.doc_id for r in t.collect()} for t in tables]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4] == ids[5]
    scores = {r.doc_id: r.predicted for r in queries.op2_toxicity(spark, sf).collect()}
    assert ids[1] == {i for i in ids[0] if not scores[i]}
    assert {r.doc_id: r.n_chars for r in tables[2].collect()} == {r.doc_id: len(r.text) for r in tables[2].collect()}
    groups = components([(r.doc_id, r.text) for r in tables[2].collect()])
    assert ids[3] == {i for i, n, c in groups if i == c or not n}
    leaks = {r.doc_id for r in decontaminate.find_leaks(tables[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids[4] == ids[3] - leaks
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, tables[-1].collect()))


def test_stages_take_odd_tables(spark, odd, none, sf):
    full = lambda t: t.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, full(odd), sf).count() > 0 and stage(spark, full(none), sf).count() == 0


def test_short_answers_are_found(spark):
    filler = " ".join(f"filler{k}" for k in range(60))
    items = [
        (1, "Which river runs through the old town of Marbeck and turns its nine mills? The Ösk river."),
        (2, "How many bridges did the builders of the northern road leave unfinished? Seven bridges of stone."),
        (3, "Is the red gate still open?"),
        (4, "$$$ %%% ###"),
        (5, None),
    ]
    rows = [
        (1, f"{filler} {items[0][1]}&&& {filler}", {1}),
        (2, f"{filler} ({items[1][1]}%%%{filler}", {2}),
        (3, f"{filler} {items[1][1].replace('of stone', 'of wood')} {filler}", {2}),
        (4, f"{filler} {items[0][1].replace('Ösk', 'wide')} {filler}", {1}),
        (5, f"{filler} {items[0][1].upper()} {filler}", {1}),
        (6, f"{filler} is the blue gate still open {filler}", {3}),
        (7, f"{filler} is the gate {filler} red still open", set()),
        (8, f"{filler} {items[1][1].split('?')[0]}? {filler}", set()),
        (9, f"x$$$ %%%  ###y {filler}", {4}),
        (10, "", set()),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, table).collect()}
    assert got == {(d, i) for d, _, want in rows for i in want}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, table).collect()} == {7, 8, 10}


def test_no_verbatim_item_is_lost(spark):
    sf = "/root/testdata/sf0.1"
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id in (786, 9587, 1281, 8811, 9757) or doc_id % 40 = 0")
    texts = [(r.item_id, r.text) for r in items.collect() if r.text]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in texts if t in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert {(786, 6), (9587, 6), (1281, 37), (8811, 115), (9757, 115)} <= want <= got


def test_components(spark):
    from attestra.llm.components import least_reachable
    from attestra.llm.shared import Scratch

    def got(rows):
        scratch = Scratch(spark, "test")
        return sorted(map(tuple, least_reachable(spark.createDataFrame(rows, "a long, b long"), scratch, "t").collect()))

    assert got([]) == []
    assert got([(3, 3), (5, 4), (4, 5), (5, 4), (None, 1), (2, None)]) == [(3, 3), (4, 4), (5, 4)]
    chain = [(i, i + 1) for i in range(40)]
    random.Random(3).shuffle(chain)
    star = [(100, 100 + i) for i in range(1, 60)]
    assert got(chain + star) == [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 160)]
