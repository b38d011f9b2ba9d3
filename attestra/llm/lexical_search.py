"""Ranked lexical search with a block-max index.

Documents are indexed in shards of neighbouring rows (SHARD_DOCS documents or SHARD_TERMS words at most), each of which
one task can hold. A term's postings in a shard lie in compressed blocks of BLOCK postings; beside them, uncompressed,
stand the first and last document and the greatest impact of each block. An impact is the exact contribution of a posting
before the term's weight, so that a score is a sum of weights times impacts.

A search goes through the shards with each query's threshold, the least score that can still be among the first `k`.
Moves are shallow first: the greatest impacts of the blocks over a window of WINDOW documents add up to the window's
bound, and blocks that reach into no window with a bound at the threshold are never decompressed. Of the lists, those
that together stay below the threshold propose no documents (the pivot condition: without one of the others a document
can't reach it); documents that the others propose are kept while what is known of them and the block bounds of the rest
reach the threshold, and only blocks that hold one of these are decompressed. All documents of a shard take each test at
once, in arrays. A part of the shards is searched first, and the scores found there are the thresholds for the others.

Terms: maximal runs of 0-9, A-Z lower-cased, a-z and characters beyond ASCII. w = floor(1000 ln((2N+2)/(2 df+1))); a
document's m = 10 + (90 n N) div L; impact = (10^9 tf) div (1000 tf + 8 m).

Defined cases: null and empty texts have no terms and are found by nothing; a query without terms, or with none that occur,
finds nothing; rows of one query id are one query with the terms of all; equal scores stand by ascending doc_id; rows that repeat a doc_id are documents of their own; rows with a
null doc_id or query id are left out of everything; texts are read whole; an empty table on either side gives an empty result; columns but the
id and the text are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.shared import Scratch, in_slices
from attestra.llm.word_blocks import block_numbers, packed, unpacked

SHARD_DOCS, SHARD_TERMS, BLOCK, WINDOW = 16_384, 8_000_000, 128, 64
#: Queries, and terms of queries, of one pass over the index; terms up to which an index is built for the queries' terms alone.
QUERIES_AT_ONCE, TERMS_AT_ONCE, MOST_TERMS = 5_000, 1_000_000, 200_000
#: One of so many shards is searched first.
FIRST_OF = 16
RESULT = "query_id long, doc_id long, score long"

_TERM = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TERM).split()


@dataclass
class Index:
    """postings (shard, term, firsts, lasts, tops, blocks), with a row of term null for each shard, whose one block holds
    its doc_ids; frequencies (term, df); the number of documents and of all their terms."""

    rows: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int


def _postings(wanted: frozenset | None):
    types = {"shard": pa.int64(), "term": pa.binary(), "df": pa.int64(), "n_docs": pa.int64(), "n_terms": pa.int64(), "data": pa.binary()}

    def run(batches):
        numbers = block_numbers()

        def fresh():
            return next(numbers), [], [], defaultdict(list)

        def rows(shard, ids, sizes, held) -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            n = np.array(sizes, np.int64)
            yield batch_of([(shard, None, None, int((n > 0).sum()), int(n.sum()), np.array(ids, "<i8").tobytes())])
            out = []
            for term, flat in held.items():
                pairs = np.array(flat, np.int32).reshape(-1, 2)
                out.append((shard, term, len(pairs), None, None, packed(np.concatenate([pairs[:, 0], pairs[:, 1], n[pairs[:, 0]]]))))
                if len(out) == 2000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        def batch_of(some):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types.values())], names=list(types))

        shard, ids, sizes, held = fresh()
        total = 0
        for batch in in_slices(batches, 200):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text or b"")
                if len(ids) >= SHARD_DOCS or total >= SHARD_TERMS:
                    yield from rows(shard, ids, sizes, held)
                    (shard, ids, sizes, held), total = fresh(), 0
                counts = Counter(words)
                for term in counts if wanted is None else wanted & counts.keys():
                    held[term] += (len(ids), counts[term])
                ids.append(doc_id)
                sizes.append(len(words))
                total += len(words)
        yield from rows(shard, ids, sizes, held)

    return run


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 10 + (90 * n.astype(np.int64) * n_docs) // n_terms
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _as_blocks(n_docs: int, n_terms: int):
    """Postings in blocks, with the greatest impact of each."""

    def run(batches):
        for batch in in_slices(batches):
            out = defaultdict(list)
            for term, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if term is None:
                    firsts, lasts, tops, blocks = [], [], [], [zstandard.compress(data)]
                else:
                    docs, tf, n = unpacked(data).reshape(3, -1)
                    impact = impacts(tf, n, n_docs, n_terms).astype(np.int32)
                    at = np.arange(0, len(docs), BLOCK)
                    firsts, lasts, tops = docs[at], docs[np.append(at[1:], len(docs)) - 1], np.maximum.reduceat(impact, at)
                    blocks = [packed(np.concatenate([np.diff(docs[a : a + BLOCK], prepend=0), impact[a : a + BLOCK]])) for a in at.tolist()]
                for name, value in (("firsts", firsts), ("lasts", lasts), ("tops", tops), ("blocks", blocks)):
                    out[name].append(value)
            lists = [pa.array(out[c], pa.list_(pa.int32())) for c in ("firsts", "lasts", "tops")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(out["blocks"], pa.list_(pa.binary()))], names=["shard", "term", "firsts", "lasts", "tops", "blocks"])

    return run


def build_index(docs: DataFrame, scratch: Scratch, terms: frozenset | None = None) -> Index:
    """The index of docs (doc_id, text, ...) in scratch, which the caller removes. With `terms`, of these terms alone; scores
    of queries over them don't change by that."""
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    read = scratch.write(source.mapInArrow(_postings(terms), "shard long, term binary, df long, n_docs long, n_terms long, data binary"), "postings")
    sums = read.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("t")).first()
    frequencies = scratch.write(read.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    blocks = read.select("shard", "term", "data").mapInArrow(_as_blocks(sums["d"], max(sums["t"], 1)), "shard long, term binary, firsts array<int>, lasts array<int>, tops array<int>, blocks array<binary>")
    rows = scratch.write(blocks, "index")
    scratch.remove("postings")
    return Index(rows, frequencies, sums["d"], sums["t"])


class _Postings:
    """One term's list in one shard. Blocks are decompressed when they are asked for, and once."""

    def __init__(self, firsts, lasts, tops, blocks, n_docs: int) -> None:
        self.firsts, self.lasts, self.tops, self.blocks = np.array(firsts), np.array(lasts), np.array(tops, np.int64), blocks
        self.top = int(self.tops.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.windows = np.zeros(-(-n_docs // WINDOW), np.int64)
        for a, b, top in zip((self.firsts // WINDOW).tolist(), (self.lasts // WINDOW + 1).tolist(), self.tops.tolist()):
            np.maximum(self.windows[a:b], top, out=self.windows[a:b])

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.open:
            deltas, impact = unpacked(self.blocks[b]).reshape(2, -1)
            self.open[b] = np.cumsum(deltas), impact.astype(np.int64)
        return self.open[b]

    def within(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of the blocks that reach into windows that are alive."""
        before = np.concatenate([[0], np.cumsum(alive)])
        some = np.flatnonzero(before[self.lasts // WINDOW + 1] > before[self.firsts // WINDOW])
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, impact = (np.concatenate(x) for x in zip(*map(self.block, some.tolist())))
        keep = alive[docs // WINDOW]
        return docs[keep], impact[keep]

    def of(self, docs: np.ndarray) -> np.ndarray:
        """The impacts in documents, which stand in order; 0 where the term doesn't occur."""
        out = np.zeros(len(docs), np.int64)
        at = np.searchsorted(self.lasts, docs)
        there = at < len(self.lasts)
        there[there] = self.firsts[at[there]] <= docs[there]
        for b in np.unique(at[there]).tolist():
            held, impact = self.block(b)
            here = np.flatnonzero(there & (at == b))
            place = np.minimum(np.searchsorted(held, docs[here]), len(held) - 1)
            out[here] = np.where(held[place] == docs[here], impact[place], 0)
        return out


def best_in_shard(lists: list[tuple[int, _Postings]], doc_ids: np.ndarray, least: int, k: int) -> list[tuple[int, int]]:
    """(doc_id, score) of the shard's first k documents with scores of `least` and above 0. lists: weight and postings of each term."""
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * x[1].top)
    if not lists:
        return []
    least = max(least, 1)
    most = np.array([w * p.top for w, p in lists])
    bounds = np.array([w * p.windows for w, p in lists])

    def scores(docs: np.ndarray) -> np.ndarray:
        return sum(w * p.of(docs) for w, p in lists)

    whole = bounds.sum(0)
    if least == 1:  # no threshold yet: documents of the block with the greatest bounds give one
        w, p = lists[-1]
        seeds = p.block(int(np.argmax(p.tops)))[0]
        if len(seeds) >= k:
            least = max(1, int(np.partition(scores(seeds), len(seeds) - k)[len(seeds) - k]))
    alive = whole >= least
    if not alive.any():
        return []
    proposing = int(np.searchsorted(np.cumsum(most), least))  # the lists below stay under the threshold together
    known = np.zeros(len(doc_ids), np.int64)
    found = []
    for w, p in lists[proposing:]:
        docs, impact = p.within(alive)
        known[docs] += w * impact
        found.append(docs)
    docs = np.unique(np.concatenate(found))
    rest = bounds[:proposing].sum(0)
    score = known[docs]
    for j in range(proposing - 1, -1, -1):
        keep = score + rest[docs // WINDOW] >= least
        docs, score = docs[keep], score[keep]
        if not len(docs):
            return []
        score = score + lists[j][0] * lists[j][1].of(docs)
        rest = rest - bounds[j]
    keep = score >= least
    docs, score = docs[keep], score[keep]
    first = np.lexsort((doc_ids[docs], -score))[:k]
    return [(int(doc_ids[d]), int(s)) for d, s in zip(docs[first], score[first])]


def _search(queries: list[tuple[int, list[tuple[bytes, int]]]], least: dict[int, int], k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = {t: row for t, *row in zip(*(table[c].to_pylist() for c in ("term", "firsts", "lasts", "tops", "blocks")))}
        doc_ids = np.frombuffer(zstandard.decompress(rows.pop(None)[3][0]), "<i8")
        postings: dict[bytes, _Postings] = {}
        out = []
        for query_id, terms in queries:
            here = []
            for term, weight in terms:
                if term in rows:
                    if term not in postings:
                        if len(postings) >= 20_000:
                            postings.clear()
                        postings[term] = _Postings(*rows[term], len(doc_ids))
                    here.append((weight, postings[term]))
            out += [(query_id, *x) for x in best_in_shard(here, doc_ids, least.get(query_id, 0), k)]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "doc_id", "score"), columns)})

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _weighed(queries: DataFrame, index: Index) -> Iterator[list[tuple[int, list[tuple[bytes, int]]]]]:
    """Queries of terms that occur, with the terms' weights, in blocks."""
    terms = queries.mapInArrow(_distinct_terms, "query_id long, term binary").join(index.frequencies, "term")
    by_query = terms.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("term", "df"))).alias("terms"))
    block, total = [], 0
    for r in by_query.orderBy("query_id").toLocalIterator():
        block.append((r["query_id"], [(bytes(t["term"]), math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * t["df"] + 1)))) for t in r["terms"]]))
        total += len(r["terms"])
        if len(block) == QUERIES_AT_ONCE or total >= TERMS_AT_ONCE:
            yield block
            block, total = [], 0
    if block:
        yield block


def _distinct_terms(batches):
    for batch in in_slices(batches):
        pairs = [(q, t) for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in set(terms_of(text or b""))]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.binary())], names=["query_id", "term"])


def search(index: Index, queries: DataFrame, scratch: Scratch, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score) of the first k documents of every query (query_id, text). Rows are in scratch."""
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long"), F.col("text").cast("binary").alias("text"))
    spark = asked.sparkSession
    early = F.pmod(F.xxhash64("shard"), F.lit(FIRST_OF)) == 0
    parts = []
    for number, block in enumerate(_weighed(asked, index)):
        least: dict[int, int] = {}
        for name, some in (("early", early), ("late", ~early)):
            found = index.rows.where(some).groupBy("shard").applyInArrow(_search(block, least, k), RESULT)
            parts.append(scratch.write(found, f"found_{number}_{name}"))
            if name == "early":
                least = {r["query_id"]: r["score"] for r in _first(parts[-1], k).where(F.col("rank") == k).collect()}
    found = parts[0] if parts else spark.createDataFrame([], RESULT)
    for part in parts[1:]:
        found = found.unionByName(part)
    return _first(found, k).select("query_id", "rank", "doc_id", "score")


def terms_to_index(queries: DataFrame) -> frozenset | None:
    """The queries' terms, if they are few enough to be sent to all tasks; else None, for an index of all terms."""
    terms = queries.select(F.col("query_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_distinct_terms, "query_id long, term binary").select("term").distinct()
    some = terms.limit(MOST_TERMS + 1).collect()
    return frozenset(bytes(r["term"]) for r in some) if len(some) <= MOST_TERMS else None
