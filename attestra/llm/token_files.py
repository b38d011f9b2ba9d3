"""Token ids as ORC files.

Texts are put in ascending doc_id order by a range partitioning, encoded narrowly, and written as ORC: integer run-length
encoding of the ids, a row index and a Bloom filter on doc_id in every stripe, so that files are read stripe by stripe in
parallel and lookups by doc_id skip stripes by their metadata. `lookup` relies on that.

Encoding works on chunks (an optional space and the text up to the next white space), over which the byte-level split
never reaches; each distinct chunk is encoded once per worker by the tokenizers library, within a bounded memo. Ids are
the library's own for whole texts, its added tokens included.

Defined cases: a null or empty text has the end id alone; a text of any length is encoded whole, as one row; repeated
doc_ids are each written, in text order; a null doc_id sorts first; an empty table writes no documents. Only doc_id and text are read from the input.
"""

from __future__ import annotations

import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.shared import in_slices, settled, texts_of

#: Unicode white space, as the pre-tokenizer's \s has it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
MEMO_CHUNKS = 800_000
#: Bytes of text that go to one file, where there are many.
PART_BYTES = 128 << 20
#: place: the row in its file, from 0.
FILE_SCHEMA = "doc_id long, place long, ids array<int>"
_worker: dict = {}


#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class _Memo(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.model._resize_cache(0)  # this memo is its cache

    def __missing__(self, chunk: str) -> bytes:
        bare = chunk[1:] if chunk[0] == " " else chunk
        if bare.isalpha():  # letters alone are one piece for the model, in its byte-level alphabet
            byte_level = chunk.replace(" ", _BYTES[32]) if chunk.isascii() else chunk.encode().decode("latin-1").translate(_BYTES)
            ids = array("I", [t.id for t in self.model.tokenize(byte_level)]).tobytes()
        elif bare[-1:] in ".," and bare[:-1].isalpha():  # letters and punctuation are split apart
            ids = self[chunk[:-1]] + self[chunk[-1]]
        else:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= 40 and len(self) < MEMO_CHUNKS:
            self[chunk] = ids
        return ids


class Encoder:
    """text -> bytes of ids, as the library gives them for the whole text. Added tokens are taken out of a text first, as the
    library does; what stands between them is cut into chunks."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items()}
        if odd := [c for c, (_, t) in added.items() if t.lstrip or t.rstrip or t.single_word]:
            raise ValueError(f"added tokens that reach beyond themselves: {odd}")
        self.memo = _Memo(tokenizer)
        self.added = {c: array("I", [i]).tobytes() for c, (i, _) in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def __call__(self, text: str) -> bytes:
        memo = self.memo.__getitem__
        if self.split is None or not any(map(text.__contains__, self.added)):
            return b"".join(map(memo, _CHUNK.findall(text)))
        return b"".join(self.added[x] if k % 2 else b"".join(map(memo, _CHUNK.findall(x))) for k, x in enumerate(self.split.split(text)))


def encoder(path: str) -> Encoder:
    """Kept per worker process."""
    if path not in _worker:
        _worker[path] = Encoder(path)
    return _worker[path]


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """FILE_SCHEMA in ascending doc_id order over and inside partitions."""

    def encode(batches):
        import numpy as np

        of = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        row = 0
        for batch in in_slices(batches):
            ids = [of(t) + end for t in texts_of(batch.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").view("<i4"))
            place = pa.array(np.arange(row, row + len(ids)))
            row += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), place, pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "place", "ids"])

    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))
    # The bounds of the ranges are sampled on the driver: short keys, of which rows of one doc_id have several.
    ordered = docs.repartitionByRange(parts, "doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, FILE_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    (
        encode_documents(docs, tokenizer, end_id)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """FILE_SCHEMA and file: the number of the file, ascending as the doc_ids are."""
    return (
        spark.read.schema(FILE_SCHEMA)
        .orc(path)
        .select("doc_id", "place", "ids", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int").alias("file"))
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id: the predicate reaches the ORC reader, which skips stripes by statistics and Bloom filter."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids))


def token_digest(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_token_files gives. start adds the totals of the files before (one
    row a file) and a running sum inside the file, over rows of four numbers. Only counts are shuffled, never ids."""

    def sums(batches):
        import numpy as np

        for batch in batches:
            doc_id, place, lists, file = batch.columns
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at, at[1:])]
            n = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([doc_id, place, file, n, pa.array(crc, pa.int64())], names=["doc_id", "place", "file", "n_tokens", "ids_crc32"])

    rows = settled(stored.mapInArrow(sums, "doc_id long, place long, file int, n_tokens long, ids_crc32 long"))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.coalesce(inside, F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
