"""Quality rules by compression bands.

A text's zstandard ratio (raw bytes over compressed bytes) must lie in a band whose limits depend on its length: short
texts can't be compressed much, long ones always can. The same holds for every fixed chunk of the text, so that a
repetitive or random part can't hide in a long document. A rest too short for a chunk is judged within the text's last
CHUNK bytes, and from TAIL_LEAST bytes on also by the limits of a text of its length. Base counts (symbols, repeated lines and windows) come with it.

Defined cases: a null or empty text has no words, fails the base rule and is rejected; a null doc_id is judged and stays
null; texts of any length are read whole, chunk by chunk; a ratio that equals a limit is within it; repeated rows are
judged each, alike; extra columns, of whatever names, pass unread; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from attestra.llm.shared import in_slices, texts_of

#: Bytes from which a band holds, and its least and greatest ratio at zstandard level 3.
DOCUMENT_BANDS = (
    (0, 0.45, 1.6),
    (128, 0.8, 2.4),
    (512, 1.15, 2.4),
    (2048, 1.3, 2.55),
    (8192, 1.4, 2.75),
    (32768, 1.5, 3.0),
    (262144, 1.5, 3.4),
)
#: For chunks of CHUNK bytes and a last one of CHUNK_LEAST or more; a shorter rest is a tail (see `in_bands`).
CHUNK, CHUNK_LEAST, CHUNK_BAND, LEVEL = 4096, 1024, (1.2, 2.6), 3
TAIL_LEAST = 128

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, worst_chunk_high double, worst_chunk_low double, kept boolean"
)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    repeat = 0
    if len(seen) < len(windows):
        until = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeat += i + 3 - max(i, until)
                until = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


def _document_band(n: int) -> tuple[float, float]:
    return DOCUMENT_BANDS[bisect_right(DOCUMENT_BANDS, n, key=lambda b: b[0]) - 1][1:]


def in_bands(raw: bytes, compress) -> tuple[bool, float, float, float]:
    """compress: a function from bytes to compressed bytes."""
    low, high = _document_band(len(raw))
    ratio = len(raw) / len(compress(raw)) if raw else 0.0
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
    tail = chunks[-1] if len(raw) > CHUNK and len(chunks[-1]) < CHUNK_LEAST else b""
    if tail:
        chunks[-1] = raw[-CHUNK:]
    ratios = [len(c) / len(compress(c)) for c in chunks if len(c) >= CHUNK_LEAST]
    top, bottom = max(ratios, default=ratio), min(ratios, default=ratio)
    fine = low <= ratio <= high and (not ratios or CHUNK_BAND[0] <= bottom and top <= CHUNK_BAND[1])
    if fine and len(tail) >= TAIL_LEAST:
        low, high = _document_band(len(tail))
        fine = low <= len(tail) / len(compress(tail)) <= high
    return fine, ratio, top, bottom


def quality_rules(docs: DataFrame) -> DataFrame:
    """One narrow pass; no shuffle."""

    def judge(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in in_slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                n, chars, symbols, dup, repeat = base_counts(text)
                failed = n < 50 or 100 * repeat > 50 * n
                fine, ratio, top, bottom = in_bands(text.encode("utf-8", "surrogatepass"), compress)
                rows.append((doc_id, n, chars, symbols, dup, repeat, failed, ratio, top, bottom, fine and not failed))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.bool_()] + [pa.float64()] * 3 + [pa.bool_()]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(judge, SCHEMA)
