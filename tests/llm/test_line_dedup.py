import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from attestra.llm import line_dedup, queries
from attestra.llm.shared import Scratch

KEEP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, min_chars=20):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(KEEP)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect()), key=str)


def test_small_tables(spark, odd, none):
    common = "This line is in very many documents."
    rows = [(i, f"first {i}\n{common if i % 2 else common.upper()}\n\n  {common}\t\nlast") for i in range(12)] + [(50, common), (51, "É" + common), (52, "é" + common), (53, "É" + common)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert got(none) == []
    assert {"lang", "score", "_ld_at"} - set(line_dedup.dedup_lines(odd).columns) <= {"_ld_at"}


def test_query_is_exact_and_in_batches_of_any_number(spark, sf, documents):
    d = duckdb.connect()
    d.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = {r[0]: r[1:] for r in d.sql(queries.OP1_SQL).fetchall()}
    rows = queries.op1_line_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows} == want
    for batches, fanout in ((1, 3), (3, 2), (6, 2), (7, 3)):
        kept = line_dedup.dedup_lines(documents, batches=batches, fanout=fanout).select("doc_id", "kept_text").collect()
        assert {r.doc_id: hashlib.sha256(r.kept_text.encode()).hexdigest() for r in kept} == {k: v[2] for k, v in want.items()}


def test_runs_keep_one_row_for_each_key(spark):
    """Batches that share keys in every way: counts add up, the first keeper stays, at every level and over all runs."""
    held = [[k for k in range(40) if k % (b + 2) == 0 or k % 7 == b] for b in range(7)]
    for fanout in (2, 3):
        scratch = Scratch(spark, "test-runs")
        runs = line_dedup.LineRuns(scratch, 4, fanout)
        for b, keys in enumerate(held):
            runs.add(spark.createDataFrame([(k, k * k, 1 + k % 3, 1000 - b) for k in keys], "_ld_h1 long, _ld_h2 long, n_docs long, keeper long"))
            for run in runs.tables():
                assert run.count() == run.select(*line_dedup.KEY).distinct().count()
        got = {r._ld_h1: (r.n_docs, r.keeper) for r in runs.merged().collect()}
        assert got == {k: (sum(k in keys for keys in held) * (1 + k % 3), 1000 - next(b for b in range(7) if k in held[b])) for k in range(40) if any(k in keys for keys in held)}
        assert runs.merged().count() == len(got)
        runs.close()
        scratch.remove()


def test_main_path_is_native(documents):
    plan = line_dedup.dedup_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert F is not None
