"""Byte-level BPE over distinct words.

Texts are cut by the tokenizer's pattern into pre-tokens. Within a block of texts (`word_blocks`) each pre-token stands
once, the most frequent first, and the texts are sequences of its places. The pre-tokens of all blocks are exploded and
shuffled by themselves, so that equal ones meet; each distinct one is merged once, by rank. The ids go back to the blocks,
gathered by block before they are shuffled, and are put together by position. Decoding takes each id's bytes from the
table of tokens, which is as long as the vocabulary.

Merging: of all neighbouring parts whose joined bytes have a rank those of the least rank are joined, the leftmost first.
Special tokens are ordinary text.

Defined cases: null and empty texts have no ids; texts and pre-tokens of any length are encoded whole; rows that repeat a
doc_id are each encoded, and so are rows with a null one; other columns are not read, whatever their names; an empty table
gives an empty one. Ids that no token has, and null ids, are an error in decoding; null lists decode to nothing. A rank
file in which a byte has no rank is refused.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import word_blocks
from attestra.llm.shared import Scratch, in_slices, texts_of

#: Bytes from which a pre-token is merged with a heap; words whose ids a task gathers before it sends them.
LONG, GATHERED = 400, 1_000_000
_NEVER = 1 << 60
_loaded: dict[str, dict[bytes, int]] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    """token -> rank, which is its id; kept per worker process."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} bytes have no rank in {path}")
        _loaded[path] = ranks
    return _loaded[path]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    if word in ranks:
        return [ranks[word]]
    if len(word) >= LONG:
        return _merged_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    rank = lambda i: ranks.get(parts[i] + parts[i + 1], _NEVER)
    pairs = [rank(i) for i in range(len(parts) - 1)]
    while pairs and (least := min(pairs)) < _NEVER:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = rank(i - 1)
        if i < len(pairs):
            pairs[i] = rank(i)
    return [ranks[p] for p in parts]


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with the pairs in a heap: ends[i] is the end of the part that begins at i, 0 once i is no beginning."""
    n = len(word)
    ends, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and ends[i] < n and (r := ranks.get(word[i : ends[ends[i]]])) is not None:
            heapq.heappush(heap, (r, i, ends[ends[i]]))

    while heap:
        _, i, end = heapq.heappop(heap)
        middle = ends[i]
        if not middle or middle >= n or ends[middle] != end:
            continue  # one of the two has been joined otherwise
        ends[i], ends[middle] = end, 0
        if end < n:
            before[end] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


_TYPES = {
    "block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "codes": pa.binary(),
    "first": pa.int32(), "words": pa.list_(pa.binary()), "kind": pa.string(),
}
_ROWS = "block long, doc_ids array<long>, sizes array<int>, codes binary, first int, words array<binary>, kind string"


def _blocks(pattern: str):
    """Rows of texts and rows of words, by kind."""

    def row(**columns):
        return pa.RecordBatch.from_arrays([pa.array([columns.get(n)], t) for n, t in _TYPES.items()], names=list(_TYPES))

    def ended(block, codes, texts):
        if not texts:
            return
        words = [w.encode() for w in codes]
        counts = np.bincount(np.concatenate([c for _, some in texts for c in some]), minlength=len(words)).tolist()
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words))
        for doc_ids, some in texts:
            yield row(kind="texts", block=block, doc_ids=doc_ids, sizes=list(map(len, some)), codes=word_blocks.packed(place[np.concatenate(some)]))
        for first, part in word_blocks.word_rows([words[i] for i in order]):
            yield row(kind="words", block=block, first=first, words=part)

    def run(batches):
        cut = regex.compile(pattern).findall
        numbers, codes, texts, tokens = word_blocks.block_numbers(), word_blocks.Codes(), [], 0
        for batch in in_slices(batches, 100):
            if len(codes) >= word_blocks.MOST_WORDS or tokens >= word_blocks.MOST_TOKENS:
                yield from ended(next(numbers), codes, texts)
                codes, texts, tokens = word_blocks.Codes(), [], 0
            coded = [codes.of(cut(t)) for t in texts_of(batch.column(1))]
            texts.append((batch.column(0).to_pylist(), coded))
            tokens += sum(map(len, coded))
        yield from ended(next(numbers), codes, texts)

    return run


def _encoded_once(path: str):
    """(block, codes, sizes, ids) of rows (block, code, word) that stand in order of their words: each distinct word is merged
    once, and what goes to one block goes together."""

    def gathered(parts):
        block, code, size, flat = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(block, kind="stable")
        values, ends = word_blocks.spread(np.cumsum(size) - size, size, flat, order)
        block, code, size, ends = block[order], code[order], size[order], np.append(ends, 0)
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(block)]):
            arrays = code[a:b], size[a:b], values[ends[a - 1] : ends[b - 1]]
            yield pa.RecordBatch.from_arrays([pa.array([block[a]]), *(pa.array([word_blocks.packed(x)], pa.binary()) for x in arrays)], names=["block", "codes", "sizes", "ids"])

    def run(batches):
        ranks, last, known, parts, n = ranks_of(path), None, [], [], 0
        for batch in batches:
            words = batch.column(2).dictionary_encode()
            lists = []
            for word in words.dictionary.to_pylist():
                if word != last:
                    last, known = word, merged(word, ranks)
                lists.append(known)
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(size.sum()))
            at = words.indices.to_numpy()
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), size[at], word_blocks.spread(np.cumsum(size) - size, size, flat, at)[0]))
            n += len(at)
            if n >= GATHERED:
                yield from gathered(parts)
                parts, n = [], 0
        if n:
            yield from gathered(parts)

    return run


def tokens_of(path: str) -> pa.Array:
    """The bytes of each id; null for ids that no token has."""
    ranks = ranks_of(path)
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.large_binary())


def bytes_of(lists: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The bytes of each list of ids."""
    ids = lists.flatten()
    if ids.null_count or (len(ids) and (np.asarray(ids).min() < 0 or np.asarray(ids).max() >= len(tokens))):
        raise ValueError("ids that no token has")
    found = tokens.take(ids)
    if found.null_count:
        raise ValueError("ids that no token has")
    counts = lists.value_lengths().fill_null(0).to_numpy()
    ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] if len(found) else np.zeros(1, np.int64)
    stops = ends[np.concatenate([[0], np.cumsum(counts)])]
    data = found.buffers()[2] if len(found) else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(stops.astype(np.int64).tobytes()), data]).cast(pa.binary())


def _put_together(path: str, decoded: bool):
    """One block's texts as ids."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        empty = [np.zeros(0, np.int32)]
        codes, sizes, flat = (np.concatenate(empty + [word_blocks.unpacked(x) for x in words[c].to_pylist()]) for c in ("codes", "sizes", "ids"))
        start, length = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        start[codes], length[codes] = np.cumsum(sizes, dtype=np.int64) - sizes, sizes
        tokens, parts = tokens_of(path) if decoded else None, []
        for doc_ids, n, some in zip(*(texts[c].to_pylist() for c in ("doc_ids", "sizes", "codes"))):
            ids, ends = word_blocks.spread(start, length, flat, word_blocks.unpacked(some))
            stops = np.concatenate([[0], ends])[np.cumsum([0, *n])]
            lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids))
            parts.append([pa.array(doc_ids, pa.int64()), lists, *([bytes_of(lists, tokens)] if decoded else [])])
        names, types = ("doc_id", "ids", "decoded"), (pa.int64(), pa.list_(pa.int32()), pa.binary())
        return pa.table({name: pa.chunked_array(x, t) for name, t, x in zip(names, types, zip(*parts) if parts else [[]] * (2 + decoded))})

    return run


def encode_documents(docs: DataFrame, ranks: str, pattern: str, scratch: Scratch, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text, ...), and with `decoded` the bytes that the ids decode to, in the same pass. ranks:
    path of a rank file. The result reads from scratch, which the caller removes when it has been used."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_blocks(pattern), _ROWS)
    blocks = scratch.write_bucketed(rows, "bpe_blocks", buckets, "block", "kind")
    words = blocks.where("kind = 'words'").select("block", "first", F.posexplode("words").alias("at", "word"))
    words = words.select("block", (F.col("first") + F.col("at")).alias("code"), "word")
    encoded = words.repartition(buckets, "word").sortWithinPartitions("word").mapInArrow(_encoded_once(ranks), "block long, codes binary, sizes binary, ids binary")
    texts = blocks.where("kind = 'texts'").select("block", "doc_ids", "sizes", "codes")
    result = "doc_id long, ids array<int>" + ", decoded binary" * decoded
    return texts.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_put_together(ranks, decoded), result)


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of each list of ids. Narrow; the table of tokens is bounded by the vocabulary."""

    def run(batches):
        tokens = tokens_of(ranks)
        for batch in in_slices(batches, 200):
            doc_id, lists = batch.columns
            yield pa.RecordBatch.from_arrays([doc_id, lists, bytes_of(lists, tokens)], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
