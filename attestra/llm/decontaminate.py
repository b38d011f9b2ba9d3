"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The test items are indexed: postings per term, in item order, in blocks that know their greatest impact. An impact is the
term's BM25 weight in the item as a share of the weight that the item itself would get as a query, so that one threshold
(`share`) fits items of any length. Every passage of every training text is a query: windows of twice the longest item's
words, one item's length apart, so that any copy of an item lies within one window. Terms whose greatest impacts add up
to less than the threshold can't bring an item over it alone; only postings of the others (essential) propose
candidates. Their cursors move together in item order to the least item that any proposes (the pivot); if the greatest
impacts of its block can't reach the threshold, all cursors skip to the next block, else the pivot is scored. All items
above are retrieved.
A retrieved item counts as leaked if the passage also holds `overlap` of the word trigrams of its question (all but the
last sentence) and of its answer (the last sentence; without one, the last third). In a part of under SHORT words one
changed word may take most trigrams away, so it may also be held by `overlap` of its words in order in one place, and so
may an item of FEW to SHORT words as a whole. Words are runs of letters and digits, folded by Unicode, in items and texts.

Defined cases: null or empty items are not indexed, and equal items are each reported; null or empty texts hold nothing;
an item of under three words must occur as a whole, and so must one without letters or digits; texts are read whole; rows
that repeat a doc_id count as one document that holds what any of them holds (`find_leaks`; rows with a null doc_id are
one such document) or are judged each (`drop_leaks`); ties in score are all retrieved; extra columns pass through unread;
an empty table or benchmark finds nothing. A benchmark of over `most_terms` words is searched in several passes, by parts
of its items; statistics are those of all items, so that this changes no result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared import in_slices

K1, B, BLOCK = 1.2, 0.75, 64
#: From 10 words on, one changed word leaves at least 5 of 8 trigrams.
SHORT = 10
#: Fewer words in almost the same order are met by chance; such items keep to trigrams.
FEW = 6
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BETWEEN = re.compile(r"[\W_]+")
_ASCII = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes([32]) * 128
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def words_of(text: str) -> list[bytes]:
    """Runs of letters and digits, compatibility-composed and case-folded."""
    if text.isascii():
        return text.encode().translate(_ASCII).split()
    return _BETWEEN.sub(" ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())).encode().split()


def signs_of(text: str) -> bytes:
    """The text between single blanks, for items that have no words."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split())


def trigrams(words: list[bytes]) -> set[tuple]:
    return set(zip(words, words[1:], words[2:])) if len(words) > 2 else {tuple(words)} if words else set()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    sentences = _SENTENCE.split(text.strip())
    question, answer = words_of(" ".join(sentences[:-1])), words_of(sentences[-1])
    if question and len(answer) > 2:
        return question, answer
    words = words_of(text)
    cut = max(1, len(words) - max(3, len(words) // 3))
    return words[:cut], words[cut:] or words


def aligned(part: list[bytes], words: list[bytes]) -> float:
    """The greatest share of the part's words that stand in order among len(part) + 1 words in a row."""
    known, best = set(part), 0
    for i in [i for i, w in enumerate(words) if w in known]:
        row = [0] * (len(part) + 1)
        for w in words[i : i + len(part) + 1]:
            if w in known:
                before = 0
                for k, p in enumerate(part, 1):
                    before, row[k] = row[k], before + 1 if p == w else max(row[k], row[k - 1])
        best = max(best, row[-1])
    return best / len(part)


class Statistics:
    """Of all items: in how many each word occurs, how many have words, their mean and greatest length."""

    def __init__(self, texts: Iterable[str | None]) -> None:
        self.held: Counter = Counter()
        self.n = self.longest = total = 0
        for text in texts:
            if words := words_of(text or ""):
                self.held.update(set(words))
                self.n, self.longest, total = self.n + 1, max(self.longest, len(words)), total + len(words)
        self.mean = total / max(1, self.n)

    def idf(self, term: bytes) -> float:
        return math.log(1 + (self.n - self.held[term] + 0.5) / (self.held[term] + 0.5))


class BlockMaxIndex:
    def __init__(self, items: list[tuple[int, str]], share: float, of: Statistics | None = None) -> None:
        """of: the statistics of all items, of which these may be a part."""
        of = of or Statistics(t for _, t in items)
        #: (id, signs) of the items without words.
        self.signs = [(i, signs_of(t)) for i, t in items if t and not words_of(t) and t.strip()]
        items = [(i, t, w) for i, t in items if (w := words_of(t or ""))]
        self.share = share
        #: Ids by index; those of `signs` come last.
        self.ids = [i for i, _, _ in items] + [i for i, _ in self.signs]
        self.words = [w for _, _, w in items]
        self.parts = [[(p, trigrams(p)) for p in question_and_answer(t)] for _, t, _ in items]
        self.longest = of.longest
        self.terms: list[dict[bytes, float]] = []
        for _, _, words in items:
            weight = {t: of.idf(t) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / of.mean)) for t, f in Counter(words).items()}
            own = sum(weight.values())
            self.terms.append({t: w / own for t, w in weight.items()})
        #: Per term: the greatest impact of each block of items.
        self.block_max: dict[bytes, dict[int, float]] = defaultdict(dict)
        for i, terms in enumerate(self.terms):
            for t, w in terms.items():
                blocks = self.block_max[t]
                blocks[i // BLOCK] = max(w, blocks.get(i // BLOCK, 0.0))
        #: Per essential term: the items that it may propose, ascending.
        self.essential: dict[bytes, list[int]] = defaultdict(list)
        for i, terms in enumerate(self.terms):
            free = 0.0
            for t, w in sorted(terms.items(), key=lambda x: (-of.held[x[0]], x[0])):
                free += w
                if free >= share - 1e-9:
                    self.essential[t].append(i)
        self.vocabulary = frozenset(self.essential)

    def retrieve(self, query: set[bytes], rare: set[bytes]) -> list[tuple[int, float]]:
        """All items whose impacts in the query reach the share, ascending. rare: the query's essential terms."""
        found = []
        lists = [self.essential[t] for t in rare]
        at = [0] * len(lists)
        pivot, bounded = min((x[0] for x in lists), default=None), None
        while pivot is not None:
            block = pivot // BLOCK
            if block != bounded:
                bounded, bound = block, sum(self.block_max[t].get(block, 0.0) for t in query if t in self.block_max)
            if bound < self.share - 1e-9:
                least = (block + 1) * BLOCK
            else:
                terms, least = self.terms[pivot], pivot + 1
                score = sum(w for t, w in terms.items() if t in query) if len(terms) < len(query) else sum(terms.get(t, 0.0) for t in query)
                if score >= self.share - 1e-9:
                    found.append((pivot, score))
            pivot = None
            for k, items in enumerate(lists):
                i = at[k]
                if i < len(items) and items[i] < least:
                    i = at[k] = bisect_left(items, least, i)
                if i < len(items) and (pivot is None or items[i] < pivot):
                    pivot = items[i]
        return found

    def search(self, text: str, overlap: float) -> dict[int, tuple[float, float, float]]:
        """Leaked items of a text: index -> best (score, question overlap, answer overlap)."""
        words = words_of(text)
        hits: dict[int, tuple[float, float, float]] = {}
        if self.signs:
            held = signs_of(text)
            hits = {i: (1.0, 1.0, 1.0) for i, (_, t) in enumerate(self.signs, len(self.words)) if t in held}
        if self.vocabulary.isdisjoint(words):
            return hits
        step = max(self.longest, 8)
        places = [i for i, w in enumerate(words) if w in self.vocabulary]
        last = max(0, -(-(len(words) - 2 * step) // step))
        windows = sorted({k for i in places for k in (min(i // step, last), min(i // step - 1, last)) if k >= 0})
        for k in windows:
            window = words[k * step : (k + 2) * step]
            query = set(window)
            got = self.retrieve(query, query & self.vocabulary)
            if not got:
                continue
            grams = trigrams(window)
            for i, score in got:
                held = self.overlaps(i, window, grams, overlap)
                if min(held) >= overlap and (score, *held) > hits.get(i, (0.0, 0.0, 0.0)):
                    hits[i] = (score, *held)
        return hits

    def overlaps(self, i: int, window: list[bytes], grams: set[tuple], overlap: float) -> list[float]:
        """How much of the item's question and of its answer the window holds."""
        held = []
        for part, few in self.parts[i]:
            if len(part) > 2:
                held.append(len(few & grams) / len(few))
                if held[-1] < overlap and len(part) < SHORT <= len(self.words[i]):
                    held[-1] = max(held[-1], aligned(part, window))
            else:
                held.append(float(_contains(window, tuple(part))) if part else 1.0)
        if min(held) < overlap and FEW <= len(self.words[i]) < SHORT:
            whole = aligned(self.words[i], window)
            held = [max(h, whole) for h in held]
        return held


def _contains(words: list[bytes], few: tuple) -> bool:
    return any(tuple(words[i : i + len(few)]) == few for i in range(len(words) - len(few) + 1))


def index_parts(benchmark: DataFrame, share: float, most_terms: int) -> Iterable[BlockMaxIndex]:
    """The items' index in parts of at most most_terms words (an item at least), one after the other; a part is what every
    task gets at once."""
    items = benchmark.where("item_id is not null").select("item_id", "text").orderBy("item_id", "text")
    of = Statistics(r["text"] for r in items.toLocalIterator())
    part, size = [], 0
    for r in items.toLocalIterator():
        n = len((r["text"] or "").split())
        if part and size + n > most_terms:
            yield BlockMaxIndex(part, share, of)
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += n
    if part:
        yield BlockMaxIndex(part, share, of)


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, overlap: float = 0.6, most_terms: int = 500_000) -> DataFrame:
    """HITS: one row for each leaked item of each doc_id."""
    spark = docs.sparkSession
    hits = None
    for index in index_parts(benchmark, share, most_terms):
        shared = spark.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            index = shared.value
            for batch in in_slices(batches):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for i, (score, q, a) in index.search(text or "", overlap).items():
                        rows.append((doc_id, index.ids[i], score, q, a))
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3)],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        found = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(search, HITS)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], HITS)
    return hits.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, overlap: float = 0.6, most_terms: int = 500_000) -> DataFrame:
    """The documents that hold no item, with all their columns; narrow, without a shuffle."""
    for index in index_parts(benchmark, share, most_terms):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches, shared=shared):
            index = shared.value
            for batch in in_slices(batches):
                at = batch.schema.get_field_index("text")
                yield batch.filter(pa.array([not index.search(t or "", overlap) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
