"""Phrase collocations by hashed counting (PCY/DHP) with Apriori pruning.

Per language, phrases of 2 to `longest` words that occur `least` times or more are counted exactly, and scored by the
weakest of their cuts. Texts are read once, into blocks (`word_blocks`): sequences of word places. Each pass over the blocks

* takes back which of its phrases of k words are frequent in the whole corpus,
* proposes a phrase of k + 1 words wherever two frequent ones overlap (Apriori) and its hash falls into a bucket that
  `least` phrases or more fell into (PCY), which a bitmap of all buckets tells,
* counts its proposals, once for each block, and the hashes of k + 2 words over overlapping proposals (DHP), for the next bitmap.

Proposals of all blocks meet by language and phrase and are added up exactly; so the buckets only save work, and any
number of them gives the same result. Bucket counts stop at `least`, which a sum of stopped counts reaches if and only if
the sum does. Only the bitmap, whose size is a parameter, is sent to all tasks.

A candidate is dropped if a longer one that holds it is as frequent. Occurrences of a phrase are no fewer than those of a
longer one around it, so it is enough to look at the phrases of one word more.

Defined cases: null and empty texts have no words; a null language counts as `und`; rows count as they are, whatever their
doc_id, which is not read, nor is any other column but text and lang; texts of any length are read whole, and phrases never reach over the end of
one; ties in score stand by frequency, then by phrase in byte order; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm import word_blocks
from attestra.llm.shared import Scratch, in_slices, settled
from attestra.llm.word_blocks import packed, unpacked

#: Buckets of hashed phrases, as a power of two, and those of one segment, which is added up by itself.
BUCKET_BITS, SEGMENT_BITS = 24, 16
#: In a block's sequence: an end of a piece, or a word that is too rare for any phrase.
BREAK = 0

_CUT = bytes(ord(".") if b in b".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b for b in range(256))
_TYPES = {
    "block": pa.int64(), "lang": pa.string(), "seq": pa.binary(), "proposed": pa.binary(), "words": pa.list_(pa.binary()),
    "first": pa.int32(), "counts": pa.list_(pa.int32()), "kind": pa.string(),
}
_ROWS = "block long, lang string, seq binary, proposed binary, words array<binary>, first int, counts array<int>, kind string"
#: kinds: a block's sequence and the words it uses; its phrases of the pass with their counts; a segment of its bucket counts.
BLOCK_ROW, PHRASE_ROW, BUCKET_ROW = "block", "phrases", "buckets"


def words_of(text: bytes) -> list[bytes]:
    """The words, with `.` between and around pieces."""
    return text.lower().translate(_CUT).replace(b".", b" . ").split(b" ")


def _row(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([columns.get(n)], t) for n, t in _TYPES.items()], names=list(_TYPES))


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def buckets_at(hashes: np.ndarray, seq: np.ndarray, at: np.ndarray, size: int, bits: int) -> np.ndarray:
    """The buckets of the phrases of `size` words that begin at the places `at`."""
    mixed = np.zeros(len(at), np.uint64)
    for j in range(size):
        mixed = (mixed ^ hashes[seq[at + j]]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def _bucket_rows(buckets: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    found, counts = np.unique(buckets, return_counts=True)
    counts = np.minimum(counts, least)
    segments = found >> SEGMENT_BITS
    edges = np.flatnonzero(np.diff(segments, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(found)]):
        yield _row(block=int(segments[a]), seq=packed(found[a:b] & ((1 << SEGMENT_BITS) - 1)), proposed=packed(counts[a:b]), kind=BUCKET_ROW)


def _phrase_rows(block: int, lang: str, phrases: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for first, some in word_blocks.word_rows(phrases):
        yield _row(block=block, lang=lang, words=some, first=first, counts=counts[first : first + len(some)].tolist(), kind=PHRASE_ROW)


def _read_blocks(least: int, bits: int):
    """The first pass: texts as blocks of one language, their words counted, pairs of neighbours hashed."""

    def ended(block: int, lang: str, codes: word_blocks.Codes, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        seq, words = np.concatenate(parts), list(codes)
        counts = np.bincount(seq, minlength=len(words))
        counts[BREAK] = 0
        yield _row(block=block, lang=lang, seq=packed(seq), words=[], kind=BLOCK_ROW)  # every word is proposed
        yield from _phrase_rows(block, lang, words, counts)
        at = np.flatnonzero((seq[:-1] > BREAK) & (seq[1:] > BREAK))
        yield from _bucket_rows(buckets_at(word_hashes(words, lang), seq, at, 2, bits), least)

    def run(batches):
        numbers, held, tokens = word_blocks.block_numbers(), {}, 0

        def all_ended():
            for lang, (codes, parts) in held.items():
                yield from ended(next(numbers), lang, codes, parts)
            held.clear()

        for batch in in_slices(batches, 100):
            if tokens >= word_blocks.MOST_TOKENS or sum(len(c) for c, _ in held.values()) >= word_blocks.MOST_WORDS:
                yield from all_ended()
                tokens = 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in held:
                    held[lang] = word_blocks.Codes(), [np.zeros(1, np.int32)]
                    held[lang][0][b"."] = BREAK
                codes, parts = held[lang]
                seq = codes.of([w for w in words_of(text or b"") if w])
                parts += (seq, np.zeros(1, np.int32))
                tokens += len(seq) + 1
        yield from all_ended()

    return run


def _next_pass(k: int, longest: int, least: int, bits: int, bitmap: bytes):
    """One block after its frequent phrases of k words are known: proposals of k + 1 words, hashes of k + 2."""

    def run(blocks: pa.Table, kept: pa.Table) -> pa.Table:
        rows = [_empty()]
        for row in blocks.to_pylist():
            rows += _passed(row, kept)
        return pa.Table.from_batches(rows)

    def _passed(row: dict, kept: pa.Table) -> Iterator[pa.RecordBatch]:
        block, lang, seq, words = row["block"], row["lang"], unpacked(row["seq"]), row["words"]
        proposed = seq if k == 1 else unpacked(row["proposed"])
        if not kept.num_rows:
            return
        codes = kept["code"].to_numpy()
        frequent = np.zeros(max(int(proposed.max()), int(codes.max())) + 1, np.int32)
        if k == 1:  # from now on only frequent words count, and have places of their own
            frequent[codes] = np.arange(1, len(codes) + 1)
            words = [b"", *kept["phrase"].to_pylist()]
            seq = begins = frequent[proposed]
        else:
            frequent[codes] = codes
            begins = frequent[proposed]
        hashes, seen = word_hashes(words, lang), np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
        at = np.flatnonzero((begins[:-1] > 0) & (begins[1:] > 0))
        at = at[seen[buckets_at(hashes, seq, at, k + 1, bits)] > 0]
        if not len(at):
            return
        pairs = begins[at].astype(np.int64) << 32 | seq[at + k]
        _, first, code, counts = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
        phrases = [b"", *(b" ".join(words[x] for x in seq[i : i + k + 1].tolist()) for i in at[first].tolist())]
        new = np.zeros(len(seq), np.int32)
        new[at] = code + 1
        yield from _phrase_rows(block, lang, phrases, np.concatenate([[0], counts]))
        if k + 1 < longest:
            yield _row(block=block, lang=lang, seq=packed(seq), proposed=packed(new), words=words, kind=BLOCK_ROW)
            both = np.flatnonzero((new[:-1] > 0) & (new[1:] > 0))
            yield from _bucket_rows(buckets_at(hashes, seq, both, k + 2, bits), least)

    return run


def _empty() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES.values()], names=list(_TYPES))


def _full_buckets(least: int):
    """(segment, bits) of rows in order of their segments: which of its buckets reach `least`. One segment is held at a time."""

    def run(batches):
        segment, sums = None, np.zeros(1 << SEGMENT_BITS, np.int64)

        def done():
            if segment is not None:
                bits = np.packbits(sums >= least, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([bits], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for of, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if of != segment:
                    yield from done()
                    segment, sums = of, np.zeros(1 << SEGMENT_BITS, np.int64)
                sums[unpacked(places)] += unpacked(counts)
        yield from done()

    return run


def _bitmap(rows: DataFrame, least: int, bits: int) -> bytes:
    """The bits of all buckets. 2 ** (bits - 3) bytes come to the driver."""
    counts = rows.where(F.col("kind") == BUCKET_ROW).select(F.col("block").alias("segment"), "seq", "proposed")
    full = counts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_full_buckets(least), "segment long, bits binary")
    out = bytearray(1 << (bits - 3))
    size = 1 << (SEGMENT_BITS - 3)
    for r in full.toLocalIterator():
        out[r["segment"] * size : (r["segment"] + 1) * size] = r["bits"]
    return bytes(out)


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """(block, code, lang, phrase, f) of a pass's phrases that are frequent in the whole corpus. A phrase has one row for each
    block, however often it occurs there."""
    each = rows.where(F.col("kind") == PHRASE_ROW).select("block", "lang", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    each = each.select("block", (F.col("first") + F.col("at")).alias("code"), "lang", F.col("x.words").alias("phrase"), F.col("x.counts").cast("long").alias("n")).where("n > 0")
    total = F.sum("n").over(Window.partitionBy("lang", "phrase"))
    return each.select("block", "code", "lang", "phrase", total.alias("f")).where(F.col("f") >= least)


def frequent_phrases(docs: DataFrame, scratch: Scratch, longest: int = 5, least: int = 100, bucket_bits: int = BUCKET_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of 1 to `longest` words that occur `least` times, and (lang, n): the words of
    each language. Both in scratch."""
    if not SEGMENT_BITS <= bucket_bits <= 30:
        raise ValueError(f"bucket_bits must be {SEGMENT_BITS} to 30")
    source = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    rows = scratch.write(source.mapInArrow(_read_blocks(least, bucket_bits), _ROWS), "pass_1", partition_by="kind")
    counted = rows.where(F.col("kind") == PHRASE_ROW)
    words = scratch.write(counted.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")), "words")
    parts = []
    for k in range(1, longest + 1):
        kept = scratch.write(_frequent(rows, least), f"kept_{k}")
        parts.append(kept.groupBy("lang", F.lit(k).alias("size"), F.col("phrase").cast("string").alias("phrase")).agg(F.first("f").alias("f")))
        if k == longest:
            break
        bitmap = _bitmap(rows, least, bucket_bits)
        blocks = rows.where(F.col("kind") == BLOCK_ROW).select("block", "lang", "seq", "proposed", "words")
        own = kept.select("block", "code", "phrase")
        step = blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_next_pass(k, longest, least, bucket_bits, bitmap), _ROWS)
        rows = scratch.write(step, f"pass_{k + 1}", partition_by="kind")
        scratch.remove(f"pass_{k}")
    phrases = parts[0]
    for part in parts[1:]:
        phrases = phrases.unionByName(part)
    return scratch.write(phrases, "phrases"), words


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of every phrase of two words or more: l and r belong to its weakest cut."""
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"))
    cuts = cuts.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(words, "lang")
    # Products of up to 38 digits are exact.
    score = F.expr("(1000BD * (cast(a as decimal(19,0)) * cast(n as decimal(19,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "size", "a", "n").agg(weakest).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def _inside_longer(phrases: DataFrame) -> DataFrame:
    """(lang, phrase) of the phrases that a phrase of one word more holds as often."""
    longer = phrases.where("size > 2").select("lang", F.col("f").alias("g"), F.split("phrase", " ", -1).alias("w"))
    size = F.size("w") - 1
    parts = F.array(*(F.array_join(F.slice("w", a, size), " ") for a in (1, 2)))
    held = longer.select("lang", "g", F.explode(parts).alias("phrase"))
    return phrases.join(held, ["lang", "phrase"]).where("g >= f").select("lang", "phrase")


def collocations(docs: DataFrame, scratch: Scratch, longest: int = 5, least: int = 100, most: int = 2000, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` phrases of each language of docs (lang, text, ...)."""
    phrases, words = frequent_phrases(docs, scratch, longest, least, bucket_bits)
    left = scored(phrases, words).join(_inside_longer(phrases), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return settled(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
