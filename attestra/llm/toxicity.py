"""Toxicity by a weighted finite-state pattern grammar.

A text becomes a sequence of symbols, one for each token: insults (words and word stems with weights learned from labelled
texts, see `learn_insults`), harms, intents, targets, negations, words of report, quotation marks and ends of clauses and
lines. Small weighted transducers (`transducers`) are composed into two, one that reads forwards and one that reads
backwards:

* threat: a harm shortly after an intent becomes a threat, which is a hit as an insult is;
* target: a hit near a target, before or after it, weighs more, once;
* negation: a hit near a negation, before or after it, weighs less, once;
* reported speech: a hit after a word of report in its clause weighs less, and so does one between quotation marks that
  open and close within its line.

A clause, which ends where a sentence does, scores the sum of its hits' weights, a text the sum over its matched clauses;
what stands outside matched clauses counts for nothing. A logistic curve in the logarithm of the sum, fitted to labelled
texts, gives the score of 0 to 1.

Learning: every feature of the labelled toxic texts is weighed, and its purity compares the number of toxic texts that
hold it with that of all texts. Both count distinct texts, and a feature must occur in `least` neighbourhoods (estimated
from a 64-bit sketch), so that copies of one toxic text teach no accidental words. It must also be more frequent there
than chance explains (SIGNIFICANT). None of these limits depends on the number of texts. The learned arcs are added to
the seed words. Only doc_id joins texts with labels.

Defined cases: a null or empty text matches nothing and gets the curve's lowest score; a null doc_id is scored and stays
null; labels that are null or without text teach nothing, a text with several labels is toxic if one says so; without
toxic labels the grammar keeps its seed words; texts of any length are read whole; repeated rows are scored each, alike;
extra columns pass unread; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.run_hashes import distinct, run_hashes
from attestra.llm.shared import in_blocks, in_slices, sent_if_few, settled, texts_of
from attestra.llm.transducers import Transducer, between, compose, read, within
from attestra.llm.word_blocks import Codes, spread

_LETTERS = r"[^\W\d_]"
#: Words, with a short ending after an apostrophe; ends; quotation marks before a word and after one.
_TOKEN = re.compile(rf"{_LETTERS}+(?:['’](?:re|s|ve|ll|d|m|t)\b)?|[.!?;:\n]|[\"“”„«»]")
_WORD_TOKEN = re.compile(rf"{_LETTERS}+")
_MARK = re.compile(r"[\"“”„«»]")
_OPENING, _CLOSING = "«„", "»”"
#: Fixed word lists (English, German, French, Spanish).
SEED_INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "worthless", "pathetic", "disgusting", "loser", "clown")
TARGETS = frozenset("you your yours you're you’re u they them he she him du dich dir ihr euch tu toi vous ustedes usted te eres".split())
NEGATIONS = frozenset("not never neither nor isn isn't isn’t aren aren't aren’t wasn wasn't wasn’t don don't don’t doesn doesn't doesn’t nicht kein keine nie pas jamais ni nunca jamás".split())
REPORTS = frozenset("said says called calls quoted wrote claimed alleged sagte nannte schrieb behauptete appelé écrit dijo llamó escribió".split())
INTENTS = frozenset("will gonna going shall werde werden vais voy".split())
HARMS = frozenset("kill hurt beat destroy shoot stab burn töten schlagen verletzen tuer frapper blesser matar golpear herir".split())
NEGATED, REPORTED, TARGETED, THREAT, SPAN = 0.5, 0.6, 1.25, 3.0, 3
STEMS = range(3, 7)
#: Words that a worker remembers to have looked up.
WORDS_SEEN = 400_000
#: Features that a task counts at once, and the two hashes of one.
FEATURES_HELD, HASHES = 300_000, (1, 2)
#: Least exponent of Chernoff's bound on the chance of so many toxic texts: exp(-9) at most.
SIGNIFICANT = 9.0
SEEDS = {f"={w}": 4.0 for w in SEED_INSULTS}

#: Symbols. A hit carries what has been found out about it, so that no factor is applied twice.
WORD, HARM, INTENT, TARGET, NEGATION, REPORT, OPEN, CLOSE, END, LINE = "word harm intent target negation report open close end line".split()
HITS = {(t, n, q): f"hit{'T' * t}{'N' * n}{'Q' * q}" for t in (0, 1) for n in (0, 1) for q in (0, 1)}
HIT = HITS[0, 0, 0]
ALPHABET = (WORD, HARM, INTENT, TARGET, NEGATION, REPORT, OPEN, CLOSE, END, LINE, *HITS.values())
_KINDS = {w: kind for kind, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (INTENT, INTENTS), (TARGET, TARGETS), (HARM, HARMS)) for w in words}
_HIT_SYMBOLS = frozenset(HITS.values())


def _marking(at: int, weight: float) -> dict:
    """The rules that set mark `at` of a hit that doesn't have it."""
    return {symbol: (HITS[tuple(1 if k == at else x for k, x in enumerate(marks))], weight) for marks, symbol in HITS.items() if not marks[at]}


def forward_grammar() -> Transducer:
    ends = (END, LINE)
    return compose(
        within(SPAN, [INTENT], {HARM: (HIT, THREAT)}, ends, ALPHABET),
        within(SPAN, [TARGET], _marking(0, TARGETED), ends, ALPHABET),
        within(SPAN, [NEGATION], _marking(1, NEGATED), ends, ALPHABET),
        between([REPORT], [], _marking(2, REPORTED), ends),
    )


def backward_grammar() -> Transducer:
    ends = (END, LINE)
    return compose(
        within(SPAN, [TARGET], _marking(0, TARGETED), ends, ALPHABET),
        within(SPAN, [NEGATION], _marking(1, NEGATED), ends, ALPHABET),
        between([CLOSE], [OPEN], _marking(2, REPORTED), [LINE]),
    )


class Grammar:
    """arcs: feature -> weight, where a feature is "=word" or "^stem"."""

    def __init__(self, arcs: dict[str, float]) -> None:
        self.arcs = arcs
        #: Words that have been looked up, and the weights of those that are insults.
        self.seen: set[str] = set()
        self.weights: dict[str, float] = {}
        self.forward, self.backward = forward_grammar(), backward_grammar()

    def insult(self, word: str) -> float:
        get = self.arcs.get
        found = get("=" + word, 0.0)
        for n in STEMS:
            if len(word) > n:
                found = max(found, get("^" + word[:n], 0.0))
        return found

    def look_up(self, words: set[str]) -> None:
        new = words - self.seen
        if len(self.seen) + len(new) > WORDS_SEEN:
            self.seen.clear()
            self.weights.clear()
            new = words
        self.seen |= new
        self.weights.update((w, weight) for w in new if (weight := self.insult(w)))

    def symbols(self, text: str) -> tuple[list[str], list[float]]:
        """The symbol of each token and the weight of each insult (1 for other tokens)."""
        symbols, weights = [], []
        for m in _TOKEN.finditer(text):
            token = m[0]
            word = _WORD_TOKEN.match(token)[0] if token[0].isalpha() else token
            insult = self.weights.get(word, 0.0)
            if insult:
                symbols.append(HIT)
            elif token == "\n":
                symbols.append(LINE)
            elif token in ".!?;:":
                symbols.append(END)
            elif _MARK.match(token):
                symbols.append(_quotation(token, text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]))
            else:
                symbols.append(_KINDS.get(token, WORD))
            weights.append(insult or 1.0)
        return _paired(symbols), weights

    def match(self, text: str) -> tuple[float, int]:
        """The text's clause sum and its number of matched clauses."""
        text = text.lower()
        words = set(_WORD_TOKEN.findall(text))
        self.look_up(words)
        if HARMS.isdisjoint(words) and self.weights.keys().isdisjoint(words):
            return 0.0, 0
        symbols, weights = self.symbols(text)
        symbols = read(self.backward, read(self.forward, symbols, weights), weights, backwards=True)
        total, clauses, matched = 0.0, 0, False
        for symbol, weight in zip(symbols, weights):
            if symbol in _HIT_SYMBOLS:
                total, matched = total + weight, True
            elif symbol == END or symbol == LINE:
                clauses, matched = clauses + matched, False
        return total, clauses + matched


def _quotation(mark: str, before: str, after: str) -> str:
    """Does a mark open, close or neither, by its kind and the characters around it."""
    if mark in _OPENING or mark in _CLOSING:
        return OPEN if mark in _OPENING else CLOSE
    if before.isalnum() and after.isalnum():
        return WORD
    return OPEN if after.isalnum() or not before.strip() else CLOSE


def _paired(symbols: list[str]) -> list[str]:
    """Quotation marks that don't open and close within a line are taken for words."""
    opened = None
    for i, symbol in enumerate(symbols):
        if symbol == OPEN:
            if opened is not None:
                symbols[opened] = WORD
            opened = i
        elif symbol == CLOSE:
            if opened is None:
                symbols[i] = WORD
            opened = None
        elif symbol == LINE and opened is not None:
            symbols[opened], opened = WORD, None
    if opened is not None:
        symbols[opened] = WORD
    return symbols


class Held:
    """Rows of features (name and values) that a task has met. They are merged by name when over FEATURES_HELD, and passed
    on if half of those are left then, so that a task's memory is bounded. merge: of each value."""

    def __init__(self, names: list[str], merge: list) -> None:
        self.names, self.merge, self.held, self.size = names, merge, [], 0

    def add(self, *columns):
        """The record batch that is passed on now, if any."""
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size > FEATURES_HELD:
            self._merge()
            if 2 * self.size > FEATURES_HELD:
                yield from self.rest()

    def _merge(self) -> None:
        names, *values = zip(*self.held)
        coded = pa.concat_arrays(names).dictionary_encode()
        which, n = coded.indices.to_numpy(), len(coded.dictionary)
        self.held, self.size = [(coded.dictionary, *[f(which, np.concatenate(v), n) for f, v in zip(self.merge, values)])], n

    def rest(self):
        if self.held:
            self._merge()
            yield pa.RecordBatch.from_arrays([self.held[0][0], *map(pa.array, self.held[0][1:])], names=self.names)
            self.held, self.size = [], 0


def _sums(which, values, n: int):
    return np.bincount(which, values, n).astype(values.dtype)


def _unions(which, bits, n: int):
    """The bits of each of n sets, every one of which has some."""
    order = np.argsort(which, kind="stable")
    return np.bitwise_or.reduceat(bits[order], np.searchsorted(which[order], np.arange(n))) if n else bits[:0]


def feature_hashes(features: list[str]):
    """Two hashes of 64 bits of each feature."""
    codes = np.frombuffer("".join(features).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, features), np.int64, len(features))
    return run_hashes(codes, np.cumsum(lens) - lens, lens, HASHES)


class Features:
    """The features of words, all in arrays: h1 and h2 as `feature_hashes` gives them, the word that each belongs to, and
    the length of its stem (0 for the word itself)."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        codes = np.frombuffer("".join(["=" + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(lens) - lens
        found = [(*run_hashes(codes, starts, lens, HASHES), np.arange(len(words)), np.zeros(len(words), np.int64))]
        for n in STEMS:
            longer = np.flatnonzero(lens - 1 > n)
            stems = codes[starts[longer][:, None] + np.arange(n + 1)]
            stems[:, 0] = ord("^")
            size = np.full(len(longer), n + 1, np.int64)
            found.append((*run_hashes(stems.ravel(), np.arange(len(longer)) * (n + 1), size, HASHES), longer, size - 1))
        self.h1, self.h2, self.word, self.stem = map(np.concatenate, zip(*found))

    def names(self, at) -> pa.Array:
        own = zip(self.word[at].tolist(), self.stem[at].tolist())
        return pa.array(["^" + self.words[w][:n] if n else "=" + self.words[w] for w, n in own], pa.string())

    def numbered(self):
        """(first, which): where each distinct feature stands first, and for every feature the number of its distinct one."""
        first, which = distinct(self.h1)
        if (self.h2[first][which] != self.h2).any():  # two features with one hash
            _, first, which = np.unique(np.stack([self.h1, self.h2]), axis=1, return_index=True, return_inverse=True)
            which = which.ravel()
        return first, which

    def held(self, number, rows, codes, n: int):
        """(row, number) of the features of n numbers that each row's words have, once each. number: of each feature, -1 for
        one that doesn't count; codes: the words of rows."""
        kept = np.flatnonzero(number >= 0)
        kept = kept[np.argsort(self.word[kept], kind="stable")]
        length = np.bincount(self.word[kept], minlength=len(self.words))
        flat, ends = spread(np.cumsum(length) - length, length, number[kept], codes)
        pairs = np.unique(np.repeat(rows, np.diff(ends, prepend=0)) * n + flat)
        return pairs // max(n, 1), pairs % max(n, 1)


def _support(batches):
    """feature -> texts that hold it, and a 64-bit sketch of its neighbourhoods, from Arrow batches of texts."""
    import xxhash

    held = Held(["feature", "n", "bits"], [_sums, _unions])
    for _, texts in in_blocks(batches):
        codes, rows, bits = Codes(), [], []
        for text in texts:
            words = _WORD_TOKEN.findall(text.lower())
            rows.append(codes.of(words))
            bits += [xxhash.xxh3_64_intdigest(f"{before} {after}".encode("utf-8", "surrogatepass")) & 63 for before, _, after in zip(["", *words], words, [*words[1:], ""])]
        if not codes:
            continue
        features, at = Features(list(codes)), np.concatenate(rows).astype(np.int64)
        first, which = features.numbered()
        _, number = features.held(which, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), at, len(first))
        of_words = _unions(at, np.left_shift(np.uint64(1), np.array(bits, np.uint64)), len(codes))
        sketches = _unions(which, of_words[features.word], len(first)).view(np.int64)
        yield from held.add(features.names(first), np.bincount(number, minlength=len(first)), sketches)
    yield from held.rest()


def labels_of(labels: DataFrame, column: str, train: Column) -> DataFrame:
    """(doc_id, label) of the training rows, one per doc_id."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .where(train)
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )


class Wanted:
    """Features to count, in order of their first hash."""

    def __init__(self, features: list[str]) -> None:
        h1, h2 = feature_hashes(features)
        order = np.argsort(h1, kind="stable")
        self.h1, self.h2, self.names = h1[order], h2[order], pa.array(features, pa.string()).take(pa.array(order))

    def places(self, h1, h2):
        """The feature with each pair of hashes, -1 for one that isn't wanted."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, -1)


def _background(shared):
    """Arrow batches of (copies, text) -> feature, n: the distinct texts that hold it, each of the copies being its share.
    shared: the features to count (`Wanted`), broadcast; None counts all."""

    def background(batches):
        wanted = shared and shared.value
        counts = np.zeros(len(wanted.names) if wanted else 0)
        held = Held(["feature", "n"], [_sums])
        for batch, texts in in_blocks(batches):
            codes = Codes()
            rows = [codes.of(list(set(_WORD_TOKEN.findall(t.lower())))) for t in texts]
            if not codes:
                continue
            features, share = Features(list(codes)), 1 / batch.column(0).to_numpy()
            at, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            if wanted:
                row, number = features.held(wanted.places(features.h1, features.h2), row, at, len(counts))
                counts += np.bincount(number, share[row], len(counts))
            else:
                first, which = features.numbered()
                row, number = features.held(which, row, at, len(first))
                yield from held.add(features.names(first), np.bincount(number, share[row], len(first)))
        if wanted:
            met = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([wanted.names.take(pa.array(met)), pa.array(counts[met])], names=["feature", "n"])
        yield from held.rest()

    return background


def learn_insults(docs: DataFrame, labels: DataFrame, most_sent: int = 200_000, least: int = 3) -> dict[str, float]:
    """The learned arcs, all that pass. labels: (doc_id, label). most_sent: how many candidates may be sent to every task,
    so that the others are not counted; beyond that all features are counted, with the same result."""
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    hashes = settled(hashed.select("doc_id", "h"))
    groups = settled(hashes.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"))
    n_all = hashes.count() - groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()[0]
    known = hashes.join(labels, "doc_id").groupBy("h").agg(F.max("label").alias("label"))
    n_labels, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n_toxic or n_toxic == n_labels:
        return {}
    chance, prior = n_toxic / n_all, n_toxic / n_labels
    # Fewer toxic texts are not significant even if no other text holds the feature.
    need = max(least, SIGNIFICANT / (chance - 1 - math.log(chance)))
    toxic = hashed.join(sent_if_few(labels.where("label = 1").select("doc_id")), "doc_id").dropDuplicates(["h"]).select("text")
    filled = F.bit_count("bits")
    # A full sketch says no more than that there are many neighbourhoods.
    contexts = F.when(filled >= 58, F.lit(150)).otherwise(F.round(-64.0 * F.log1p(-F.least(filled, F.lit(58)) / 64.0)))
    candidates = settled(
        toxic.mapInArrow(_support, "feature string, n long, bits long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"))
        .where((F.col("n") >= need) & (contexts >= least))
        .select("feature", "n")
    )
    few = candidates.count() <= most_sent
    wanted = docs.sparkSession.sparkContext.broadcast(Wanted([r[0] for r in candidates.select("feature").collect()])) if few else None
    texts = hashed.select("text", "h").join(sent_if_few(groups), "h", "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), "text")
    everywhere = texts.mapInArrow(_background(wanted), "feature string, n double").groupBy("feature").agg(F.round(F.sum("n")).alias("all_n"))
    expected = F.col("all_n") * chance
    purity = F.least((F.col("n") / n_toxic * prior * n_all + 0.5) / (F.col("all_n") + 1), F.lit(0.99))
    passed = (
        candidates.join(everywhere, "feature")
        .withColumn("purity", purity)
        .where((F.col("purity") >= 0.5) & (F.col("n") > expected))
        .where(F.col("n") * F.log(F.col("n") / expected) - F.col("n") + expected >= SIGNIFICANT)
    )
    arcs = {r["feature"]: round(math.log(r["purity"] / (1 - r["purity"])) - math.log(prior / (1 - prior)), 4) for r in passed.select("feature", "purity").collect()}
    if wanted:
        wanted.unpersist()
    return arcs


def match_texts(docs: DataFrame, arcs: dict[str, float]) -> DataFrame:
    """(doc_id, clause_sum, n_clauses) of every row, in one narrow pass."""

    def match(batches):
        grammar = Grammar(arcs)
        for batch in in_slices(batches):
            got = [grammar.match(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())], names=["doc_id", "clause_sum", "n_clauses"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(match, "doc_id long, clause_sum double, n_clauses long")


def _strength(clause_sum: Column) -> Column:
    return F.log1p(clause_sum)


def fit_curve(matched: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the logistic curve in the strength of a text, by Newton's method on counts per fiftieth of
    it (under 2,000 rows, as no sum of hits exceeds exp(40))."""
    bins = (
        matched.join(labels, "doc_id")
        .groupBy((F.floor(_strength(F.col("clause_sum")) * 50) / 50).alias("x"))
        .agg(F.count("*").alias("n"), F.sum("label").alias("k"))
        .orderBy("x")
        .collect()
    )
    a, b = 0.5, -3.0
    for _ in range(60):
        g = [0.01 * (0.5 - a), 0.01 * (-3.0 - b)]
        haa, hab, hbb = 0.01, 0.0, 0.01
        for r in bins:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * r["x"] + b))))
            e, v = r["k"] - r["n"] * p, r["n"] * p * (1 - p)
            g = [g[0] + e * r["x"], g[1] + e]
            haa, hab, hbb = haa + v * r["x"] ** 2, hab + v * r["x"], hbb + v
        det = haa * hbb - hab * hab
        step = ((hbb * g[0] - hab * g[1]) / det, (haa * g[1] - hab * g[0]) / det)
        a, b = a + max(-1.0, min(1.0, step[0])), b + max(-1.0, min(1.0, step[1]))
    return max(a, 0.01), b


def learn_arcs(docs: DataFrame, labels: DataFrame, train: Column) -> tuple[dict[str, float], DataFrame]:
    """The arcs, and the labels (doc_id, label) that they were learned from. train: which rows of labels may be learned from."""
    known = settled(labels_of(labels, "toxic", train))
    return {**SEEDS, **learn_insults(docs, known)}, known


def toxicity(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(doc_id, score, clause_sum, n_clauses). train: which rows of labels may be learned from."""
    arcs, known = learn_arcs(docs, labels, train)
    matched = settled(match_texts(docs, arcs))
    a, b = fit_curve(matched, known)
    return matched.withColumn("score", 1 / (1 + F.exp(-(F.lit(a) * _strength(F.col("clause_sum")) + F.lit(b)))))


def drop_toxic(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.5) -> DataFrame:
    """The documents that score less than threshold, with all their columns. Only labelled texts are scored for the curve;
    then all are, where they are."""
    arcs, known = learn_arcs(docs, labels, train)
    labelled = docs.select("doc_id", "text").join(sent_if_few(known.select("doc_id")), "doc_id")
    a, b = fit_curve(match_texts(labelled, arcs), known)

    def clean(batches):
        grammar = Grammar(arcs)
        for batch in in_slices(batches):
            sums = (grammar.match(t)[0] for t in texts_of(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array([1 / (1 + math.exp(-max(-500.0, a * math.log1p(x) + b))) < threshold for x in sums], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
