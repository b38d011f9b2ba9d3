"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams of one to three words, lower-cased, and of one to three token shapes: case,
letters, digits and signs in order, whether a token repeats the one before or one shortly before, and whether a line
repeats. Words and shapes are taken whole, and n-grams are told apart exactly: the dictionary holds every n-gram of
SUPPORT or more texts of a bounded sample of the training rows (`sample_rows` at most, half of them of either class if there are
as many, the first by a hash of doc_id), and so is bounded by the sample. Class log-count ratios of its n-grams are
counted over every training row in Spark; the indicators are scaled by them and a linear hinge-loss model is fitted to the
sample by dual coordinate descent. A logistic curve on the margin gives the score. Every text but those of the sample is cut into n-grams once.

Defined cases: a null or empty text has the length feature alone and gets its score; a null doc_id is scored and stays
null; null labels teach nothing, and a doc_id with several labels is good if one says so; with one class only, the score is
that class's share, without labels 0.5; texts of any length are read whole; repeated rows are scored each, alike, and
stand in the sample once; extra columns pass unread; an empty table gives an empty result.
"""

from __future__ import annotations

import marshal
import math
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared import SPACES, Scratch, in_blocks, in_slices, sent_if_few, settled, texts_of
from attestra.llm.toxicity import labels_of

#: Texts of the sample that an n-gram must be in.
SUPPORT = 3
#: Characters of the texts that a task looks at together.
CHARS_AT_ONCE = 500_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SHAPES = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1"))


def _case(word: str) -> str:
    return "u" if len(word) > 2 and word.isupper() else "t" if word[:1].isupper() else "l"


def _classes(words: str) -> str:
    """Letters, digits and signs in order, of a word or of several with line ends between them."""
    for pattern, to in _SHAPES:
        words = pattern.sub(to, words)
    return words


def _shape(word: str) -> str:
    return _case(word) + _classes(word)


class Grams:
    """text -> its n-grams, some more than once: tuples of words as bytes, of shapes as text."""

    def __init__(self) -> None:
        self.shapes: dict[str, str] = {}

    def __call__(self, text: str) -> Iterator[tuple]:
        shapes = self.shapes
        grams: list[Iterable[tuple]] = [[("n", min(len(text).bit_length(), 16) // 2)]]
        lines = set()
        for line in text.split("\n"):
            words = _WORD.findall(line)
            if not words:
                continue
            grams.append([("line", line in lines)])
            lines.add(line)
            row = []
            for i, word in enumerate(words):
                shape = shapes.get(word)
                if shape is None:
                    if len(shapes) > 300_000:
                        shapes.clear()
                    shape = shapes[word] = _shape(word)
                row.append(shape)
                if i and word == words[i - 1]:
                    row[-1] = "=" + shape
                elif len(word) > 7 and word in words[max(0, i - 12) : i - 1]:
                    row[-1] = "~" + shape
            grams += [zip(row), zip(row, row[1:]), zip(row, row[1:], row[2:])]
        words = text.lower().encode("utf-8", "surrogatepass").split()
        return chain(*grams, zip(words), zip(words, words[1:]), zip(words, words[1:], words[2:]))


class Family:
    """The places of n-grams of one kind, by the numbers of their symbols (-1: none, which every table answers with -1)."""

    def __init__(self, grams: dict[tuple, int]) -> None:
        import numpy as np

        self.number: dict = {}
        for gram in grams:
            for symbol in gram:
                self.number.setdefault(symbol, len(self.number))
        self.n, number = max(len(self.number), 1), self.number
        pairs = {number[g[0]] * self.n + number[g[1]]: -1 for g in grams if len(g) > 1}
        pairs |= {number[g[0]] * self.n + number[g[1]]: at for g, at in grams.items() if len(g) == 2}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.two = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        rank = dict(zip(self.pairs.tolist(), range(len(pairs))))
        triples = {rank[number[g[0]] * self.n + number[g[1]]] * self.n + number[g[2]]: at for g, at in grams.items() if len(g) == 3}
        self.triples = np.array(sorted(triples), np.int64)
        self.three = np.array([triples[k] for k in self.triples.tolist()], np.int64)
        self.one = np.full(self.n + 1, -1, np.int64)
        for gram, at in grams.items():
            if len(gram) == 1:
                self.one[number[gram[0]]] = at

    @staticmethod
    def _found(table, keys):
        import numpy as np

        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def found(self, symbols, within):
        """(where it begins, place) of every n-gram of symbols that has a place. within: numbers of the stretches that
        n-grams don't leave."""
        import numpy as np

        if not len(symbols):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        i = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0) & (within[:-1] == within[1:]))
        pair = self._found(self.pairs, symbols[i] * self.n + symbols[i + 1])
        i, pair = i[pair >= 0], pair[pair >= 0]
        last = np.minimum(i + 2, len(symbols) - 1)
        more = np.flatnonzero((i + 2 < len(symbols)) & (symbols[last] >= 0) & (within[last] == within[i]))
        triple = self._found(self.triples, pair[more] * self.n + symbols[last[more]])
        more, triple = more[triple >= 0], triple[triple >= 0]
        begins = np.concatenate([np.arange(len(symbols)), i, i[more]])
        places = np.concatenate([self.one[symbols], self.two[pair], self.three[triple]])
        return begins[places >= 0], places[places >= 0]


class Dictionary:
    """The n-grams that are features, and their places."""

    def __init__(self, grams: list[tuple]) -> None:
        self.places = {g: i for i, g in enumerate(grams)}
        self.known = frozenset(grams)
        of_words, of_shapes, self.others = {}, {}, {}
        for g, i in self.places.items():
            (of_words if isinstance(g[0], bytes) else of_shapes if isinstance(g[-1], str) else self.others)[g] = i
        self.words, self.shapes = Family(of_words), Family(of_shapes)

    def __call__(self, grams: Iterable[tuple]) -> list[int]:
        return sorted(map(self.places.__getitem__, self.known.intersection(grams)))


@cache
def _is_space():
    import numpy as np

    return np.isin(np.arange(256), list(SPACES.encode()))


def _words(text: str):
    """(bytes, starts, distinct words, the number of each word's distinct one) of a text that ends with a space."""
    import numpy as np

    block = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    word = ~_is_space().take(block)
    edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
    starts, lens = edges[::2], edges[1::2] - edges[::2]
    ends = np.append(0, np.cumsum(lens)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(block[word])]).dictionary_encode()
    return block, starts, coded.dictionary, coded.indices.to_numpy()


class Places:
    """Texts -> (bounds, places): the sorted places of their n-grams, one text after another. What a Dictionary says of Grams,
    for a block of texts at once: its words are told apart in an Arrow dictionary, n-grams looked up as numbers in arrays."""

    def __init__(self, dictionary: Dictionary) -> None:
        import numpy as np

        self.of = dictionary
        self.vocabulary = pa.array(list(dictionary.words.number), pa.binary())
        number = dictionary.shapes.number
        bases = list({s.lstrip("=~"): None for s in number})
        #: For a shape the numbers of it, and of it with = and with ~; the last row is for shapes without any.
        self.forms = np.array([[number.get(sign + base, -1) for sign in ("", "=", "~")] for base in bases] + [[-1] * 3], np.int64)
        self.row = {base: i for i, base in enumerate(bases)}

    def _rows(self, words: list[bytes]):
        """Twice the row in forms, and 1 for a word of over 7 characters."""
        import numpy as np

        joined = b"\n".join(words).decode("utf-8", "surrogatepass")
        shapes, rows, none = _classes(joined).split("\n"), self.row, len(self.row)
        return np.array([2 * rows.get(_case(w) + shape, none) + (len(w) > 7) for w, shape in zip(joined.split("\n"), shapes)], np.int64)

    def _shapes(self, words, codes, line):
        import numpy as np

        rows = self._rows(words.to_pylist())[codes]
        form = np.zeros(len(codes), np.int64)
        beside = line[1:] == line[:-1]
        form[1:][beside & (codes[1:] == codes[:-1])] = 1
        at = np.flatnonzero((rows & 1 == 1) & (form == 0))
        near = np.zeros(len(at), bool)
        for d in range(2, 13):
            before = np.maximum(at - d, 0)
            near |= (at >= d) & (codes[before] == codes[at]) & (line[before] == line[at])
        # In Grams the first word of a longer line meets itself.
        near |= np.append(beside, False)[at] & ~np.append(False, beside)[at]
        form[at[near]] = 2
        return self.forms[rows >> 1, form]

    def __call__(self, texts: list[str]) -> tuple:
        import numpy as np

        joined = "\n".join([*texts, ""])
        block, starts, words, codes = _words(joined)
        ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
        text = np.searchsorted(ends, starts, "right")
        line = np.cumsum(block == 10)[starts]
        shapes = self._shapes(words, codes, line)
        _, _, words, codes = _words(joined.lower())  # as many words
        numbers = pc.index_in(words, value_set=self.vocabulary).fill_null(-1).to_numpy().astype(np.int64)[codes]
        found = [(text[i], places) for i, places in (self.of.words.found(numbers, text), self.of.shapes.found(shapes, line))]
        others, has_words = self.of.others, np.bincount(text, minlength=len(texts)).tolist()
        for i, t in enumerate(texts):
            marks = [("n", min(len(t).bit_length(), 16) // 2)] + [("line", False)] * (has_words[i] > 0)
            lines = t.split("\n")
            if len(set(lines)) < len(lines):
                lines = [x for x in lines if _WORD.search(x)]
                marks += [("line", True)] * (len(set(lines)) < len(lines))
            places = [others[m] for m in marks if m in others]
            found.append((np.full(len(places), i), np.array(places, np.int64)))
        size = max(len(self.of.places), 1)
        keys = np.unique(np.concatenate([at for at, _ in found]) * size + np.concatenate([places for _, places in found]))
        return np.searchsorted(keys, np.arange(len(texts) + 1) * size), keys % size


def _key(gram: tuple) -> bytes:
    return marshal.dumps(gram, 2)  # the version without references: equal n-grams give equal keys


def grams_of_sample(sample: DataFrame) -> DataFrame:
    """(label, grams) of a sample (label, text)."""

    def extract(batches):
        grams = Grams()
        for batch in in_slices(batches, 100):
            found = [list(map(_key, set(grams(t)))) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["label", "grams"])

    return sample.select("label", "text").mapInArrow(extract, "label int, grams array<binary>")


def dictionary_of(rows: DataFrame, support: int = SUPPORT) -> Dictionary:
    """The n-grams of `support` rows or more of grams_of_sample. Bounded by the sample."""
    counts = rows.select(F.explode("grams").alias("gram")).groupBy("gram").count().where(F.col("count") >= support)
    return Dictionary([marshal.loads(r["gram"]) for r in counts.orderBy("gram").toLocalIterator()])


def places_of(rows: DataFrame, dictionary) -> DataFrame:
    """(label, places) of grams_of_sample. dictionary: a broadcast Dictionary."""

    def run(batches):
        for batch in in_slices(batches, 100):
            found = [dictionary.value(map(marshal.loads, g)) for g in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["label", "places"])

    return rows.select("label", "grams").mapInArrow(run, "label int, places array<int>")


def features_of(rows: DataFrame, dictionary) -> DataFrame:
    """(doc_id, label, places) of rows (doc_id, label, text). dictionary: a broadcast Dictionary."""

    def run(batches):
        of = Places(dictionary.value)
        for batch, texts in in_blocks(batches, CHARS_AT_ONCE):
            bounds, places = of(texts)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "label", "places"])

    return rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, places array<int>")


def log_count_ratios(rows: DataFrame, n_places: int, smooth: float = 1.0):
    """Over all rows of (label, places): log of the smoothed shares of texts of either class that hold each place."""
    import numpy as np

    each = rows.select("label", F.explode("places").alias("place"))
    counts = each.groupBy("place").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q")).toPandas()
    p, q = np.full(n_places, smooth), np.full(n_places, smooth)
    p[counts["place"].to_numpy("int64")] += counts["p"].to_numpy("float64")
    q[counts["place"].to_numpy("int64")] += counts["q"].to_numpy("float64")
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[list[int]], labels: list[int], ratios, c: float = 1.0, rounds: int = 15):
    """Hinge-loss weights for indicators scaled by ratios, rows normed to length 1, classes weighed evenly; the last
    weight is the bias."""
    import numpy as np

    weights = np.zeros(len(ratios) + 1)
    data = []
    share = sum(labels) / len(labels)
    for places, label in zip(rows, labels):
        x = ratios[places]
        x = x / max(math.sqrt(float(x @ x)), 1e-9)
        y = 1.0 if label else -1.0
        data.append((np.asarray(places, int), x, y, c * 0.5 / (share if label else 1 - share)))
    alpha, order = np.zeros(len(data)), np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(data)):
            at, x, y, top = data[i]
            gradient = y * (float(weights[at] @ x) + weights[-1]) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), top)  # x.x is 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weights[at] += step * x
                weights[-1] += step
                alpha[i] = new
    return weights


def margins_of(rows: list[list[int]], ratios, weights) -> list[float]:
    out = []
    for places in rows:
        x = ratios[places]
        out.append(float(weights[places] @ x) / max(math.sqrt(float(x @ x)), 1e-9) + float(weights[-1]))
    return out


def curve_of(margins: list[float], labels: list[int]) -> tuple[float, float]:
    import numpy as np

    x, y = np.array(margins), np.array(labels, float)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p)
        g = np.array([((y - p) * x).sum() - 0.01 * (a - 1), (y - p).sum() - 0.01 * b])
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + da, b + db
    return max(float(a), 0.01), float(b)


def sample_of(rows: DataFrame, most: int) -> tuple[DataFrame, int, int]:
    """(the sample (label, text), the number of rows, that of good ones) of rows (doc_id, label, text): at most `most` rows,
    the same at each run, half of either class, or more of one if the other has fewer. Only keys are sorted; texts don't move."""
    keys = rows.select("label", "doc_id", F.xxhash64("text").alias("of"))
    n, good = keys.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    n_good = min(good, max(most // 2, most - (n - good)))
    first = lambda label, k: keys.where(F.col("label") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "of").limit(k)
    chosen = first(1, n_good).unionByName(first(0, min(n - good, most - n_good))).select("doc_id", "of")
    sample = rows.withColumn("of", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "of"]).dropDuplicates(["doc_id", "of"])
    return sample.select("label", "text"), n, good


def classify_quality(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = 4000) -> DataFrame:
    """(doc_id, score). train: which rows of labels may be learned from."""
    spark = docs.sparkSession
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    taught = sent_if_few(labels_of(labels, "quality", train))
    rows = texts.join(taught, "doc_id")
    sample, n, good = sample_of(rows, sample_rows)
    if not n or good in (0, n):
        return settled(texts.select("doc_id", F.lit(good / n if n else 0.5).alias("score")))
    with Scratch(spark, "quality") as scratch:
        known = scratch.write(grams_of_sample(sample), "sample")
        dictionary = dictionary_of(known)
        held = spark.sparkContext.broadcast(dictionary)
        marked = sorted((r["label"], r["places"]) for r in places_of(known, held).collect())
        learned = scratch.write(features_of(rows, held), "learned")
        ratios = log_count_ratios(learned, len(dictionary.places))
        marks, places = [m for m, _ in marked], [p for _, p in marked]
        weights = dual_coordinate_descent(places, marks, ratios)
        a, b = curve_of(margins_of(places, ratios, weights), marks)
        model = spark.sparkContext.broadcast((ratios, weights))

        def score(from_texts: bool):
            def blocks(batches):
                if not from_texts:
                    yield from ((batch, batch.column(1).to_pylist()) for batch in in_slices(batches))
                    return
                of = Places(held.value)
                for batch, block in in_blocks(batches, CHARS_AT_ONCE):
                    bounds, places = of(block)
                    yield batch, [places[a:b] for a, b in zip(bounds, bounds[1:])]

            def run(batches):
                ratios, weights = model.value
                for batch, found in blocks(batches):
                    got = [1 / (1 + math.exp(-max(-30.0, min(30.0, a * m + b)))) for m in margins_of(found, ratios, weights)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

            return run

        kind = "doc_id long, score double"
        others = texts.join(taught.select("doc_id"), "doc_id", "left_anti").mapInArrow(score(True), kind)
        return settled(others.unionByName(learned.select("doc_id", "places").mapInArrow(score(False), kind)))
