"""N-gram Jaccard join with adaptive multi-match prefixes; exact.

Texts with the same shingle set form one class and go on as one. Shingles are put in one global order: frequent ones
last (`frequent_shingles`, counted over all texts), the rest by hash. With n shingles and similarity t, two sets that are
similar share at least m of their first n - ceil(t n) + m, for any m up to ceil(t n). A class's m is adaptive: the
prefix is lengthened while the estimated number of candidates, its postings over m, falls; a pair must share the
lesser m of the two in the prefixes of that m before it is verified by its whole sets.

Pairs are not expanded within a group of near copies. First every posting list links its members to its most common one,
and links that hold are joined to components; members outside a list's largest component try that once more within it. Then only pairs of
different components remain; of each posting list that still has several, the members outside its largest component
meet the others. A member stays in such a list only if it has postings enough after it to share what the list's sizes and match
counts ask for at least; without that, all variants of a much copied text would meet in all of its lists, the square of their
number. Every pair that is not verified is within a component already, so components are exact.

Defined cases: a null or empty text has no shingles and links with nothing, a text of under five words is one shingle; rows
with a null doc_id are left out; rows that repeat a doc_id are one node, which has the links of each; texts are read
whole; an empty table gives an empty result. Only doc_id and text are read from the input.
"""

from __future__ import annotations

import math
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.components import least_reachable
from attestra.llm.run_hashes import run_hashes
from attestra.llm.shared import SPACES, Scratch, in_slices, sent_if_few, settled

WORDS, PERCENT = 5, 80
#: Match counts that a prefix may ask for.
MATCHES = (1, 2, 4, 8, 16)
#: How many shingles may be known as frequent (any set of them keeps the join exact; all tasks get it), and from how many
#: texts of a task on a shingle is reported.
MOST_FREQUENT, LOCALLY_FREQUENT = 300_000, 3
#: Bytes of the texts whose words a task hashes together.
BYTES_AT_ONCE = 1_000_000


def _mixed(hashes, k: int):
    """The hashes of k words each, in their order: hashes[i : i + k] for every i."""
    import numpy as np

    n = len(hashes) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):  # order matters: multiply and mix between words
        out ^= hashes[i : i + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def shingles_of(texts: list[str | None]):
    """For each text its sorted distinct 64-bit shingle hashes. The texts' words are hashed together, BYTES_AT_ONCE or one text at
    a time."""
    import numpy as np

    raw, at = [(t or "").encode("utf-8", "surrogatepass") for t in texts], 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < BYTES_AT_ONCE):
            size += len(raw[end]) + 1
            end += 1
        block = np.frombuffer(b" ".join([*raw[at:end], b""]).lower(), np.uint8)
        word = ~_is_space().take(block)
        edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))  # a word is followed by a space
        starts, ends = edges[::2], edges[1::2]
        [hashes] = run_hashes(block * word, starts, ends - starts)
        bounds = np.searchsorted(starts, np.append(0, np.cumsum([len(r) + 1 for r in raw[at:end]]))).tolist()
        whole = _mixed(hashes, WORDS) if len(hashes) >= WORDS else None
        for a, b in zip(bounds, bounds[1:]):
            if b - a < WORDS:
                yield _mixed(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64)
                continue
            s = np.sort(whole[a : b - WORDS + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            yield s[fresh]
        at = end


@cache
def _is_space():
    import numpy as np

    return np.isin(np.arange(256), list(SPACES.encode()))


def needed(n: int) -> int:
    """The least number of n shingles that a similar set shares."""
    return -(-PERCENT * n // 100)


def frequent_shingles(docs: DataFrame, most: int = MOST_FREQUENT) -> list[int]:
    """The most frequent shingles, as signed 64-bit integers, most frequent last. Each task counts all its texts (equal
    sets once) and reports what at least LOCALLY_FREQUENT of them hold; reports are added up in Spark."""

    def count(batches):
        import numpy as np

        seen = set()
        held, size, total = [], 0, None

        def merged(parts, total):
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            if total is not None:
                values, at = np.unique(np.concatenate([total[0], values]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([total[1], counts])).astype(np.int64)
            return values, counts

        for batch in in_slices(batches):
            for s in shingles_of(batch.column(0).to_pylist()):
                key = hash(s.tobytes())
                if key in seen:
                    continue
                seen.add(key)
                held.append(s)
                size += len(s)
                if size > 2_000_000:
                    total = merged(held, total)
                    held, size = [], 0
        if held:
            total = merged(held, total)
        values, counts = total if total is not None else (np.empty(0, np.uint64), np.empty(0, np.int64))
        keep = counts >= LOCALLY_FREQUENT
        yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["shingle", "n"])

    top = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = top.orderBy(F.desc("n"), "shingle").limit(most).collect()
    return [r["shingle"] for r in reversed(rows)]


def prefixes(docs: DataFrame, frequent: list[int]) -> DataFrame:
    """(doc_id, n, s1, s2, prefix): s1, s2 sign the set; prefix is long enough for the greatest match count."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def of(batches):
        import numpy as np
        import xxhash

        order = np.array(shared.value, np.int64).view(np.uint64)
        sorter = np.argsort(order)
        values = order[sorter]
        for batch in in_slices(batches):
            rows = []
            for s in shingles_of(batch.column(1).to_pylist()):
                n = len(s)
                sign = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) if n else (0, 0)
                if len(values) and n:
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    known = values[at] == s
                    last = s[known][np.argsort(sorter[at[known]])]
                    s = np.concatenate([s[~known], last])
                rows.append((n, int(sign[0]), int(sign[1]), s[: n - needed(n) + MATCHES[-1]].view(np.int64)))
            n, s1, s2, prefix = zip(*rows) if rows else ([], [], [], [])
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            flat = np.concatenate(prefix) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat))],
                names=["doc_id", "n", "s1", "s2", "prefix"],
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").where("doc_id is not null").mapInArrow(of, "doc_id long, n int, s1 long, s2 long, prefix array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the classes in ids (id, s1), from the texts with that doc_id and signature."""
    ids = sent_if_few(ids.select(F.col("id").alias("doc_id"), "s1").distinct())
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(ids, "doc_id").select("doc_id", "text", "s1")

    def sets(batches):
        import numpy as np
        import xxhash

        for batch in in_slices(batches):
            held, found = [], []
            doc_ids, texts, signs = (c.to_pylist() for c in batch.columns)
            for doc_id, s, s1 in zip(doc_ids, shingles_of(texts), signs):
                if len(s) and int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0]) == s1:
                    held.append(doc_id)
                    found.append(s)
            at = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat))], names=["id", "shingles"])

    return texts.mapInArrow(sets, "id long, shingles array<long>")


def _enough(n) -> F.Column:
    return F.ceil(n * (PERCENT / 100) - 1e-9)


def _postings(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(shingle, id, n, m, common, pos, place, after): the postings that another class shares, with each class's adaptive
    match count. pos: the place in the global order. common: how much of the class others share, greatest for the least altered of a group of
    copies; a shingle counts by the logarithm of how many hold it, as two copies with the same edit share it too. place: the place in the prefix beyond that of match count 1, so that a prefix of match count m has place < m."""
    places = classes.select("id", "n", F.posexplode("prefix").alias("pos", "shingle")).select(
        "shingle", "id", "n", "pos", F.greatest(F.lit(0), F.col("pos") - (F.col("n") - _enough(F.col("n")))).cast("int").alias("place")
    )
    shared = places.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    found = scratch.write(places.join(shared, "shingle"), "postings_all")
    # The estimated candidates of match count m: the postings of its prefix, less its own, over m.
    cost = [(F.sum(F.when(F.col("place") < m, F.col("held") - 1).otherwise(0)) / m).alias(f"c{m}") for m in MATCHES]
    costs = found.groupBy("id", "n").agg(F.sum(F.log2("held")).alias("common"), *cost)
    usable = [F.when(_enough(F.col("n")) >= m, F.struct(F.col(f"c{m}").alias("cost"), F.lit(m).alias("m"))) for m in MATCHES]
    chosen = costs.select("id", F.least(*usable, F.struct(F.lit(1e300).alias("cost"), F.lit(1).alias("m")))["m"].alias("m"), (F.col("common") / F.col("n")).alias("common"))
    return scratch.write(_ranked(found.drop("held").join(chosen, "id").where("place < m")), "postings")


def _ranked(postings: DataFrame) -> DataFrame:
    """With after: how many of these postings the class has after each one."""
    return postings.withColumn("after", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("pos"))) - 1)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. Only classes that stand in a pair are read again."""
    pairs = scratch.write(pairs, f"{name}_pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select("id", "s1"), "id")
    sets = scratch.write(shingle_sets(docs, ids), f"{name}_sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    found = scratch.write(joined.where(100 * F.col("both") >= PERCENT * (F.col("sum") - F.col("both"))).select("a", "b"), name)
    scratch.remove(f"{name}_pairs")
    scratch.remove(f"{name}_sets")
    return found


def _needs() -> F.Column:
    """How many shingles the prefixes of a pair (an, am, bn, bm) must share. Of two sets, the prefix of match count m, the
    lesser of the two, that ends first in the global order holds all that they share up to there; beyond it they share no
    more than its set has left, the needed overlap less m. So what both need together, less that, must be shared in the
    prefixes; that is m at least."""
    least = F.ceil(F.lit(PERCENT) * (F.col("an") + F.col("bn")) / (100 + PERCENT) - 1e-9)
    return least - F.greatest(_enough(F.col("an")), _enough(F.col("bn"))) + F.least("am", "bm")


def _may_be_first() -> F.Column:
    """Whether a posting (n, m, after) of a list with sizes low to high and match count least_m at least may be the first that its class
    shares with a similar member. Before rounding, _needs less its match count rises with the other's size up to n and falls beyond it,
    so it is least at the smallest or the largest size that is similar to n; rounding takes less than 1 from it."""
    ends = F.greatest(F.col("low"), F.col("n") * (PERCENT / 100)), F.least(F.col("high"), F.col("n") * (100 / PERCENT))
    needs = [(F.col("n") + x) * (PERCENT / (100 + PERCENT)) - F.greatest(F.col("n"), x) * (PERCENT / 100) for x in ends]
    return F.col("after") + 1 > F.least(*needs) + F.least("m", "least_m") - 1 - 1e-6


def _candidates(meetings: DataFrame, classes: DataFrame, scratch: Scratch, name: str, before: list[DataFrame]) -> DataFrame:
    """Pairs that share enough of their prefixes, lesser id first. meetings: one row for each shared posting, with n, m, place and after
    of both. The first shingle that a candidate pair shares has enough postings after it in both sets for the others, so pairs
    meet in the early postings alone, not in all; then what their prefixes share is counted. before: the pairs that have met in earlier
    rounds, which are decided; this round's are added."""
    near = F.least("an", "bn") * 100 >= F.greatest("an", "bn") * PERCENT
    early = (F.greatest("ap", "bp") < F.least("am", "bm")) & (F.least("af", "bf") + 1 >= _needs())
    # Turned round only now: the conditions above stand in the join and are evaluated for each of its rows.
    turned = [F.when(F.col("a") > F.col("b"), F.col(y + c)).otherwise(F.col(x + c)).alias(x + c) for c in ("", "n", "m") for x, y in ("ab", "ba")]
    met = meetings.where(near & early).select(*turned).dropDuplicates(["a", "b"])
    for pairs in before:
        met = met.join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    met = scratch.write(met, f"{name}_met")
    before.append(met)
    ids = sent_if_few(met.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    held = scratch.write(classes.join(ids, "id").select("id", "prefix"), f"{name}_prefixes")
    prefix = lambda side: held.select(F.col("id").alias(side), F.col("prefix").alias(f"{side}x"))
    part = lambda side: F.slice(f"{side}x", F.lit(1), (F.col(f"{side}n") - _enough(F.col(f"{side}n"))).cast("int") + F.least("am", "bm"))
    shared = F.size(F.array_intersect(part("a"), part("b")))
    return met.join(prefix("a"), "a").join(prefix("b"), "b").where(shared >= _needs()).select("a", "b")


def _side(postings: DataFrame, side: str):
    return [F.col("id").alias(side), F.col("n").alias(f"{side}n"), F.col("m").alias(f"{side}m"), F.col("place").alias(f"{side}p"), F.col("after").alias(f"{side}f")]


def _open_postings(postings: DataFrame, parts: DataFrame) -> DataFrame:
    """The posting lists that hold several components, with each member's component, the list's largest one, main, its least and greatest
    sizes, low and high, and its least match count."""
    placed = postings.join(parts.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").withColumn("component", F.coalesce("component", "id")).drop("of")
    bounds = lambda low, high, m: [F.min(low).alias("low"), F.max(high).alias("high"), F.min(m).alias("least_m")]
    sizes = placed.groupBy("shingle", "component").agg(F.count("*").alias("k"), *bounds("n", "n", "m"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("k", "component")).alias("m"), F.count("*").alias("parts"), *bounds("low", "high", "least_m")).where("parts > 1")
    return placed.join(main.select("shingle", F.col("m.component").alias("main"), "low", "high", "least_m"), "shingle")


def jaccard_components(docs: DataFrame, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    signed = scratch.write(prefixes(docs, frequent_shingles(docs, most_frequent)), "signed")
    classes = signed.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("c"))
    classes = classes.select(F.col("c.doc_id").alias("id"), "s1", "s2", F.col("c.n").alias("n"), F.col("c.prefix").alias("prefix"))
    classes = scratch.write(classes, "classes")
    members = scratch.write(signed.drop("prefix"), "members")
    scratch.remove("signed")
    postings = _postings(classes, scratch)
    scratch.remove("postings_all")

    # Each posting list's most common member is most like the others: a copy that few edits have touched.
    side = F.struct("common", (-F.col("id")).alias("later"), *_side(postings, "a"))
    star = ["p.a", "p.an", "p.am", "p.ap", "p.af", *_side(postings, "b")]

    before = []

    def verified(meetings: DataFrame, name: str) -> DataFrame:
        return _verified(_candidates(meetings, classes, scratch, name, before), docs, classes, scratch, name)

    stars = postings.join(postings.groupBy("shingle").agg(F.max(side).alias("p")), "shingle").select(*star)
    links = verified(stars.where("a <> b"), "links_1")
    parts = least_reachable(links, scratch, "first")

    # Two components share nothing but open postings, so these alone count as after.
    open_ = scratch.write(_ranked(_open_postings(postings.drop("after"), parts)).where(_may_be_first()), "open")

    # Then the members outside a list's largest component meet its most common member.
    inner = open_.where("component = main").groupBy("shingle").agg(F.max(side).alias("p"))
    more = verified(open_.where("component <> main").join(inner, "shingle").select(*star), "links_2")
    if more.limit(1).count():
        links = links.unionByName(more)
        open_ = scratch.write(_open_postings(open_.select(postings.columns), least_reachable(links, scratch, "second")), "still_open")

    outside = open_.where("component <> main").select("shingle", F.col("component").alias("ac"), *_side(open_, "a"))
    others = open_.select("shingle", F.col("component").alias("bc"), F.col("main"), *_side(open_, "b"))
    # Pairs of two outside members are met once.
    rest = verified(outside.join(others, "shingle").where("ac <> bc and (bc = main or a < b)"), "links_3")
    components = least_reachable(links.unionByName(rest), scratch, "third")

    class_of = classes.join(components.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select(
        "s1", "s2", F.coalesce("component", "id").alias("component_id")
    )
    out = members.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "s1", "s2").join(class_of, ["s1", "s2"], "left")
    out = settled(out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
    scratch.remove()
    return out
