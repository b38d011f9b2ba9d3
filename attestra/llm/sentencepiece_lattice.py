"""SentencePiece encoding and decoding by a relational lattice.

The model's piece table is a relation (piece, id, score). Texts are cut where no piece reaches over (`Cutter`),
and the words between the cuts are encoded apart: their substrings of bounded length are exploded, equi-joined
with the piece table, the resulting edges grouped by word, and the encoding found by a fold over the edges with the
higher-order function aggregate. For a unigram model the fold is Viterbi, in order of the edges' ends. For a model of
merges (BPE), whose encoding is not the best path by score, the fold takes the edges in order of score and joins the two
symbols that an edge spans. A character without a piece becomes its UTF-8 byte pieces.

Words that are met often (as many as `most_frequent`) are encoded once, and their ids sent to every task. The others are
encoded beside their document: rows are dealt out once by row, with the ids that are known and the words that are not,
and lattice, fold and assembly need no further shuffle. Which words count as frequent changes no result. `decode_documents`
maps ids back to texts; `encode_documents` does so too and says whether the text came back.

Defined cases: a null or empty text has no ids; texts and words of any length are encoded whole (a word is a run without
any cut; the time for one grows with the square of its length); repeated rows are texts of their own; a null doc_id stays;
empty tables give empty results. A literal U+2581 in a text is encoded as the space it stands for, so that decoding gives
a space. Only doc_id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.run_hashes import distinct, run_hashes
from attestra.llm.shared import Scratch, in_slices, short_batches, texts_of
from attestra.llm.token_counts import is_unigram

#: More pieces than this are joined by shuffle. Frequent words are sent as two hashes and ids, some 30 bytes each.
MOST_PIECES, MOST_FREQUENT = 500_000, 2_000_000
UNKNOWN_PENALTY = 10.0
PREFIX = 3
#: Characters of a word whose ends fit into the bits of a long.
BITS = 61
SPACE = "▁"
#: Words of the table of frequent words that one task encodes; distinct words that a task counts at once.
WORDS_A_PART, WORDS_HELD = 20_000, 400_000
#: Characters of the texts that a task looks at together, and rows of which it makes Python objects at a time: a worker holds
#: some 100 bytes a character while it does.
CHARS_AT_ONCE, ROWS_AT_ONCE = 250_000, 200
#: The two hashes of a word.
SEEDS = (1, 2)


class Cutter:
    """Texts -> their words, that are encoded apart: each text with a space (as SPACE) before it, cut wherever two characters
    stand side by side in no piece. No piece reaches over these cuts, nor over those between texts."""

    #: Characters below stand in a table, the others in a sorted array. A SPACE stands there as the space it is.
    FIRST = 1024

    def __init__(self, neighbours: set[str]) -> None:
        import numpy as np

        codes = [(ord(a), ord(b)) for a, b in (pair.replace(SPACE, " ") for pair in neighbours)]
        table = np.zeros((self.FIRST + 1, self.FIRST + 1), bool)
        for a, b in codes:
            if max(a, b) < self.FIRST:
                table[a, b] = True
        self.table = table.ravel()
        self.others = np.array(sorted((a << 32) + b for a, b in codes if max(a, b) >= self.FIRST), np.int64)

    def __call__(self, texts: list[str]) -> tuple:
        """(text, codes, starts, lens, counts): all texts in one and its code points, where its words start and how long they
        are, and how many each text has."""
        import numpy as np

        spaced = "".join([" " + t if t else "" for t in texts]).replace(SPACE, " ")
        codes = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        cut = np.ones(len(codes), bool)
        if len(codes):
            low = np.minimum(codes, self.FIRST).astype(np.int32)
            cut[1:] = ~self.table.take(low[:-1] * (self.FIRST + 1) + low[1:])
            at = np.flatnonzero((low[:-1] == self.FIRST) | (low[1:] == self.FIRST))
            if len(at):
                cut[at + 1] = ~np.isin((codes[at].astype(np.int64) << 32) + codes[at + 1], self.others)
            cut[ends[ends < len(codes)]] = True
        starts = np.flatnonzero(cut)
        counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        return spaced.replace(" ", SPACE), codes, starts, np.diff(starts, append=len(codes)), counts


class Pieces:
    """A model's pieces. table: (piece, id, score, rank, late), rank being the place in order of score. late marks a piece of
    which a better-scored piece can be made: joining it may open a join that comes before it (see `merge_words`).
    first_byte: the id of byte 0. cutter: see Cutter."""

    def __init__(self, spark: SparkSession, model: str) -> None:
        """The model file is small and local to the driver. A table with a piece that reaches over a cut is refused."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        self.model, self.unigram, self.first_byte, self.spelling = model, is_unigram(model), 0, []
        scores: dict[str, tuple[int, float]] = {}
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                self.first_byte = i if m.id_to_piece(i) == "<0x00>" else self.first_byte
                self.spelling.append(bytes([i - self.first_byte]))
                continue
            piece = m.id_to_piece(i)
            known = not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
            self.spelling.append(piece.replace(SPACE, " ").encode() if known else b"")
            if known:
                scores[piece] = (i, float(m.get_score(i)))
        odd = [p for p in scores if re.search(rf"[^{SPACE}]{SPACE}|\n", p)]
        if odd:
            raise ValueError(f"pieces reach over words: {odd[:5]}")
        late = set()
        for piece, (_, score) in scores.items():
            for k in range(1, len(piece)):
                for part, rest in ((piece[:k], piece[k:]), (piece[k:], piece[:k])):
                    if len(part) > 1 and part in scores and scores[part][1] < score and (len(rest) == 1 or rest in scores):
                        late.add(part)
        self.cutter = Cutter({p[i : i + 2] for p in scores for i in range(len(p) - 1)})
        self.least = min((s for _, s in scores.values()), default=0.0)
        names = [("piece", T.StringType()), ("id", T.IntegerType()), ("score", T.DoubleType()), ("rank", T.IntegerType()), ("late", T.BooleanType())]
        ranks = {s: k for k, s in enumerate(sorted({s for _, s in scores.values()}, reverse=True))}
        table = spark.createDataFrame([(p, i, s, ranks[s], p in late) for p, (i, s) in scores.items()], T.StructType([T.StructField(*x) for x in names]))
        self.table = F.broadcast(table) if len(scores) <= MOST_PIECES else table
        longest: dict[str, int] = {}
        for piece in scores:
            if len(piece) >= PREFIX:
                longest[piece[:PREFIX]] = max(len(piece), longest.get(piece[:PREFIX], 0))
        reach = spark.createDataFrame(list(longest.items()), "prefix string, reach int")
        #: (prefix, reach): how long a piece can be that begins with so many characters.
        self.reach = F.broadcast(reach) if len(longest) <= MOST_PIECES else reach

    def encode(self, words: DataFrame, keys: list[str]) -> DataFrame:
        """words (keys, word and more), of which keys tell the rows apart, with ids. A null word has null ids. If words are
        partitioned by keys or some of them, nothing is shuffled."""
        return (viterbi_words if self.unigram else merge_words)(words, keys, self)


def _byte_ids(char: Column, first: int) -> Column:
    code = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), F.octet_length(char) - 1), lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + first)


def _lattice(words: DataFrame, keys: list[str], pieces: Pieces, edge: Column) -> DataFrame:
    """words with edges: the sorted array of edge, which is made of start, len and a piece's columns; these are null for a
    character without a piece."""
    size, given = F.char_length("word"), words.columns
    start = words.select(*given, F.explode_outer(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias("start"))
    start = start.withColumn("prefix", F.substring(F.col("word"), F.col("start") + 1, F.lit(PREFIX))).join(pieces.reach, "prefix", "left")
    length = F.when(size > 0, F.sequence(F.lit(1), F.least(F.coalesce("reach", F.lit(PREFIX - 1)), size - F.col("start"))))
    cut = start.select(*given, "start", F.explode_outer(length).alias("len")).withColumn("piece", F.substring(F.col("word"), F.col("start") + 1, F.col("len")))
    found = cut.join(pieces.table, "piece", "left").where(F.col("id").isNotNull() | F.coalesce(F.col("len") == 1, F.lit(True)))
    edges = F.sort_array(F.collect_list(F.when(F.col("len").isNotNull(), edge))).alias("edges")
    return found.groupBy(*keys).agg(*[F.first(c).alias(c) for c in given if c not in keys], edges)


def _char(i: Column) -> Column:
    return F.substring(F.col("word"), i, F.lit(1))


def viterbi_words(words: DataFrame, keys: list[str], pieces: Pieces) -> DataFrame:
    """The best path of each word: the greatest sum of scores."""
    score = F.coalesce("score", F.lit(pieces.least - UNKNOWN_PENALTY))
    lattice = _lattice(words, keys, pieces, F.struct((F.col("start") + F.col("len")).alias("end"), "start", "id", score.alias("score")))
    # paths[i] is the best way to end at i: its score, then the earlier start (ties go to the longer piece), then its piece.
    node = "struct<score:double,earlier:int,id:int>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("earlier"), F.lit(None).cast("int").alias("id"))).cast(f"array<{node}>")

    def extend(paths, e):
        way = F.struct((F.element_at(paths, e["start"] + 1)["score"] + e["score"]).alias("score"), (-e["start"]).alias("earlier"), e["id"].alias("id")).cast(node)
        held = F.size(paths)
        return F.when(held > e["end"], F.concat(F.slice(paths, 1, held - 1), F.array(F.greatest(F.element_at(paths, held), way)))).otherwise(F.concat(paths, F.array(way)))

    # The folded paths are carried in the next fold's state: captured in its function, they would be folded at each step.
    state = f"struct<at:int,ids:array<int>,paths:array<{node}>>"

    def back(acc, i):
        here = F.element_at(acc["paths"], i + 1)
        ids = F.when(here["id"].isNull(), _byte_ids(_char(i), pieces.first_byte)).otherwise(F.array(here["id"]))
        step = F.struct((-here["earlier"]).alias("at"), F.concat(ids, acc["ids"]).alias("ids"), acc["paths"].alias("paths")).cast(state)
        return F.when(acc["at"] == i, step).otherwise(acc)

    whole = F.struct(F.char_length("word").alias("at"), F.array().cast("array<int>").alias("ids"), F.aggregate("edges", start, extend).alias("paths")).cast(state)
    ids = F.aggregate(F.sequence(F.char_length("word"), F.lit(1), F.lit(-1)), whole, back, lambda acc: acc["ids"])
    return lattice.select(*words.columns, F.when(F.char_length("word") > 0, ids).alias("ids"))


def merge_words(words: DataFrame, keys: list[str], pieces: Pieces) -> DataFrame:
    """The merges of each word: a fold over its edges in order of score, the leftmost of equals first. An edge that spans
    just two symbols joins them: as no edge before it is open, it is the best. Only joining a `late` piece may open an
    edge that has passed; if one is, the word is folded again (`slowly`), looking for the best open edge at each step.

    The symbols are kept as the set of their ends, in the bits of a long for words of up to BITS characters and in an
    array for longer ones."""
    # Edges of one character come first, by start; the others by score. rank holds both score and start.
    one = F.col("len") == 1
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(i, F.lit(BITS + 1)))
    end = F.col("start") + F.col("len")
    ends, inner = bit(F.col("start")).bitwiseOR(bit(end)), (bit(end) - 1).bitwiseAND(F.bitwise_not(bit(F.col("start") + 1) - 1))
    rank = F.call_function("shiftleft", F.when(one, F.lit(0)).otherwise(F.col("rank") + 1).cast("long"), F.lit(32)) + F.col("start")
    edge = F.struct(
        rank.alias("rank"), "start", end.alias("end"), ends.alias("ends"), inner.alias("inner"),
        F.coalesce("id", -1 - F.col("start")).alias("id"), (F.coalesce("late", F.lit(False)) & ~one).alias("late"),
    )
    size = F.char_length("word")
    lattice = _lattice(words, keys, pieces, edge)
    lattice = lattice.withColumn("joins", F.slice("edges", size + 1, F.size("edges")))
    ids = F.when(size <= BITS, _joined_as_bits(size)).otherwise(_joined_as_array(size))
    left = lattice.select(*words.columns, F.when(size > 0, ids).alias("left"))
    spelled = F.flatten(F.transform("left", lambda i: F.when(i < 0, _byte_ids(_char(-i), pieces.first_byte)).otherwise(F.array(i))))
    return left.select(*words.columns, F.when(F.exists("left", lambda i: i < 0), spelled).otherwise(F.col("left")).alias("ids"))


def _fold_in_order(begin: Column, opened, joined) -> Column:
    """The fold over joins, in one pass if that is exact, and once more from the start if not. begin: the symbols of one
    character each; opened(symbols, edge): does the edge span just two; joined(symbols, edge): the symbols then."""

    def join(acc, e):
        def step(at):
            passed = F.exists("joins", lambda x: (x["rank"] < e["rank"]) & ((x["start"] == e["start"]) | (x["end"] == e["end"])) & opened(at, x))
            return F.struct(at.alias("at"), (e["late"] & passed).alias("again"))

        new = F.get(F.transform(F.array(joined(acc["at"], e)), step), F.lit(0))
        return F.when(acc["again"], acc).when(opened(acc["at"], e), new).otherwise(acc)

    def slowly(at, _):
        best = F.slice(F.filter("joins", lambda e: opened(at, e)), 1, 1)
        return F.coalesce(F.get(F.transform(best, lambda e: joined(at, e)), F.lit(0)), at)

    once = F.aggregate("joins", F.struct(begin.alias("at"), F.lit(False).alias("again")), join)
    again = F.aggregate("joins", begin, slowly)
    return F.get(F.transform(F.array(once), lambda x: F.when(x["again"], again).otherwise(x["at"])), F.lit(0))


def _joined_as_bits(size: Column) -> Column:
    def opened(at, e):
        return (at.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(at.bitwiseAND(e["inner"])) == 1)

    at = _fold_in_order(F.call_function("shiftleft", F.lit(1).cast("long"), size + 1) - 1, opened, lambda at, e: at.bitwiseAND(F.bitwise_not(e["inner"])))

    def ids(at):
        left = F.filter("edges", lambda e: (at.bitwiseAND(e["ends"]) == e["ends"]) & (at.bitwiseAND(e["inner"]) == 0))
        return F.transform(F.sort_array(F.transform(left, lambda e: F.struct(e["start"].alias("start"), e["id"].alias("id")))), lambda e: e["id"])

    return F.get(F.transform(F.array(at), ids), F.lit(0))


def _joined_as_array(size: Column) -> Column:
    """For each character the symbol that starts there: its end, 0 if none does, and its id."""
    symbol = lambda end, id_: F.struct(end.alias("end"), id_.alias("id"))
    end_at = lambda at, i: F.get(at, i)["end"]

    def opened(at, e):
        middle = end_at(at, e["start"])
        return (middle > 0) & (middle < e["end"]) & (end_at(at, middle) == e["end"])

    def joined(at, e):
        middle = end_at(at, e["start"])
        return F.concat(
            F.slice(at, F.lit(1), e["start"]), F.array(symbol(e["end"], e["id"])), F.slice(at, e["start"] + 2, middle - e["start"] - 1),
            F.array(symbol(F.lit(0), F.lit(0))), F.slice(at, middle + 2, F.size(at)),
        )

    begin = F.transform(F.slice("edges", F.lit(1), size), lambda e: symbol(e["end"], e["id"]))
    return F.transform(F.filter(_fold_in_order(begin, opened, joined), lambda x: x["end"] > 0), lambda x: x["id"])


def _blocks(batches):
    """(slice of a record batch, its texts, which stand last), with CHARS_AT_ONCE characters at most or one text."""
    for batch in in_slices(batches, ROWS_AT_ONCE):
        texts, at = texts_of(batch.columns[-1]), 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CHARS_AT_ONCE):
                chars += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def word_counts(docs: DataFrame, cutter: Cutter) -> DataFrame:
    """(word, n) of every distinct word, counted in each task before the shuffle."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        def merged(held):
            hashes, counts, words = zip(*held)
            first, which = distinct(np.concatenate(hashes))
            counts = np.bincount(which, np.concatenate(counts), len(first)).astype(np.int64)
            return np.concatenate(hashes)[first], counts, pa.concat_arrays(words).take(pa.array(first))

        held, size = [], 0
        for _, texts in _blocks(batches):
            text, codes, starts, lens, _ = cutter(texts)
            [hashes] = run_hashes(codes, starts, lens, SEEDS[:1])
            first, which = distinct(hashes)
            a = starts[first]
            words = pa.array([text[x:y] for x, y in zip(a.tolist(), (a + lens[first]).tolist())], pa.string())
            held.append((hashes[first], np.bincount(which, minlength=len(first)), words))
            size += len(words)
            if size > WORDS_HELD:
                held = [merged(held)]
                size = len(held[0][0])
                if 2 * size > WORDS_HELD:
                    yield pa.RecordBatch.from_arrays([held[0][2], pa.array(held[0][1])], names=["word", "n"])
                    held, size = [], 0
        if held:
            _, counts, words = merged(held)
            yield pa.RecordBatch.from_arrays([words, pa.array(counts)], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counted: DataFrame, most: int) -> DataFrame:
    """The words of counted (word, n) that are met again, or those with n over a higher limit chosen by counts, so that they
    are `most` at most."""
    tiers = F.least("n", F.lit(1000))
    held, least = 0, 1001
    for r in counted.groupBy(tiers.alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():
        held += r["k"]
        if held > most or r["n"] < 2:
            break
        least = r["n"]
    return counted.where(tiers >= least).select("word")


class Known:
    """The ids of frequent words by two hashes of 64 bits. gap: the greatest number of the ids' type, which is no id."""

    def __init__(self, h1, h2, offsets, ids) -> None:
        import numpy as np

        self.h1, self.h2, self.offsets, self.ids = h1, h2, offsets, ids
        self.gap = int(np.iinfo(ids.dtype).max)

    def places(self, h1, h2):
        """The word with each pair of hashes, -1 for one that isn't known."""
        import numpy as np

        if not len(self.h1):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, -1)


def _hashed(words: DataFrame) -> DataFrame:
    """(h1, h2, ids) of words (word, ids)."""

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in in_slices(batches, 10_000):
            words = batch.column(0).to_pylist()
            codes = np.frombuffer("".join(words).replace(SPACE, " ").encode("utf-32-le", "surrogatepass"), np.uint32)
            lens = np.array([len(w) for w in words], np.int64)
            h = run_hashes(codes, np.cumsum(lens) - lens, lens, SEEDS)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in h), batch.column(1)], names=["h1", "h2", "ids"])

    return words.select("word", "ids").mapInArrow(hashed, "h1 long, h2 long, ids array<int>")


def known_words(docs: DataFrame, pieces: Pieces, most: int) -> Known:
    """The frequent words' ids, encoded once. The driver gets `most` rows of some 30 bytes at most."""
    import numpy as np

    scratch = Scratch(docs.sparkSession, "lattice")
    counted = scratch.write(word_counts(docs, pieces.cutter), "counted")
    words = frequent_words(counted, most)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-min(most, counted.count()) // WORDS_A_PART))
    table = _hashed(pieces.encode(words.repartition(parts, "word"), ["word"])).toArrow()
    scratch.remove()
    h1 = table.column("h1").to_numpy().view(np.uint64)
    order = np.argsort(h1, kind="stable")
    lists = table.column("ids").combine_chunks().take(order)
    kind = np.dtype("<u2" if len(pieces.spelling) < (1 << 16) - 1 else "<u4")
    h2 = table.column("h2").to_numpy().view(np.uint64)[order]
    return Known(h1[order], h2, lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(kind))


def _coded(docs: DataFrame, pieces: Pieces, known: Known) -> DataFrame:
    """(row, doc_id, sign, codes, rare): the ids of a row's known words, with a gap (the mark and two halves of a place in
    rare) for each other one, null first among the rare words; sign: a hash of the text."""
    shared, cutter = docs.sparkSession.sparkContext.broadcast(known), pieces.cutter

    def code(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        known = shared.value
        width = known.ids.dtype.itemsize
        for batch, texts in _blocks(batches):
            rows = len(texts)
            text, codes, starts, lens, counts = cutter(texts)
            h1, h2 = run_hashes(codes, starts, lens, SEEDS)
            first, which = distinct(h1)
            if (h2[first][which] != h2).any():  # two words with one hash
                _, first, which = np.unique(np.stack([h1, h2]), axis=1, return_index=True, return_inverse=True)
                which = which.ravel()
            place = known.places(h1[first], h2[first])
            found = place >= 0
            begin = np.where(found, known.offsets[place], 0)
            size = np.where(found, known.offsets[np.where(found, place + 1, 0)] - begin, 3)

            # Each row's rare words, once each: row and word are one number.
            rare = np.flatnonzero(~found[which])
            row = np.repeat(np.arange(rows), counts)[rare]
            once, at = np.unique(row * len(first) + which[rare], return_inverse=True)
            bounds = np.searchsorted(once, np.arange(rows + 1) * len(first))
            words, word = np.unique(once % len(first) if len(once) else once, return_inverse=True)
            a = starts[first[words]]
            strings = pa.array([text[x:y] for x, y in zip(a.tolist(), (a + lens[first[words]]).tolist())], pa.string())
            none = np.zeros(len(once) + rows, bool)
            none[bounds[:-1] + np.arange(rows)] = True
            taken = np.zeros(len(none), np.int64)
            taken[~none] = word
            lists = pa.ListArray.from_arrays(pa.array((bounds + np.arange(rows + 1)).astype(np.int32)), strings.take(pa.array(taken, mask=none)))

            n = size[which]
            ends = np.append(0, np.cumsum(n))
            from_ = np.arange(ends[-1]) + np.repeat(begin[which] - ends[:-1], n)
            out = known.ids.take(from_, mode="clip") if len(known.ids) else np.zeros(ends[-1], known.ids.dtype)
            local, gaps = at - bounds[row], ends[rare]
            out[gaps], out[gaps + 1], out[gaps + 2] = known.gap, local & 0x7FFF, local >> 15
            offsets = ends[np.append(0, np.cumsum(counts))] * width
            coded = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])

            signs = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(signs, pa.int64()), coded, lists], names=["row", "doc_id", "sign", "codes", "rare"]
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(code, "row long, doc_id long, sign long, codes binary, rare array<string>")


def encode_documents(docs: DataFrame, model: str, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, round_trip) of every row of docs, in any order. round_trip: decoding ids gives
    the text."""
    short_batches(docs.sparkSession)
    pieces = Pieces(docs.sparkSession, model)
    known = known_words(docs, pieces, most_frequent)
    kind, gap, spelling = known.ids.dtype, known.gap, pieces.spelling
    # Dealt out once; the row's own codes pass along at the place of the null word.
    dealt = _coded(docs, pieces, known).repartition("row")
    words = dealt.select("row", F.posexplode("rare").alias("at", "word"), F.struct("doc_id", "sign", "codes").alias("own"))
    words = words.select("row", "at", "word", F.when(F.col("at") == 0, F.col("own")).alias("own"))
    encoded = pieces.encode(words, ["row", "at"])
    found = encoded.groupBy("row").agg(
        F.first("own", ignorenulls=True).alias("own"), F.collect_list(F.when(F.col("at") > 0, F.struct("at", "ids"))).alias("rare")
    )

    def assemble(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in in_slices(batches, ROWS_AT_ONCE):
            doc_id, sign, raw, rare = batch.columns
            out, same = [], []
            for codes, mark, more in zip(raw.to_pylist(), sign.to_pylist(), rare.to_pylist()):
                coded = np.frombuffer(codes, kind)
                ids = coded.astype(np.int32)
                if more:
                    of = {r["at"] - 1: r["ids"] for r in more}
                    parts, start = [], 0
                    for i in np.flatnonzero(coded == gap).tolist():
                        parts += [ids[start:i], np.array(of[int(ids[i + 1]) | int(ids[i + 2]) << 15], np.int32)]
                        start = i + 3
                    ids = np.concatenate([*parts, ids[start:]])
                out.append(ids)
                same.append(xxhash.xxh3_64_intdigest(decoded(ids.tolist(), spelling)) >> 1 == mark)
            at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            flat = np.concatenate(out) if out else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(at, pa.array(flat)), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids", "round_trip"],
            )

    return found.select("own.doc_id", "own.sign", "own.codes", "rare").mapInArrow(assemble, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decoded(ids: list[int], spelling: list[bytes]) -> bytes:
    """The pieces of ids joined, without the space before the text."""
    return b"".join([spelling[i] for i in ids])[1:]


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of encoded (doc_id, ids); bytes that are no UTF-8 are read as U+FFFD, null ids as an empty text."""
    spelling = Pieces(encoded.sparkSession, model).spelling

    def decode(batches):
        import pyarrow as pa

        for batch in in_slices(batches):
            texts = [decoded(ids or [], spelling).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
