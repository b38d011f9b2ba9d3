"""Texts as blocks: the distinct words of neighbouring texts once, and each text as the places of its words in that list.

What is asked of all words of a corpus (their token ids, their number) is asked once for each word of a block instead of
once for each occurrence, and the answers come back by (block, code). A block ends at MOST_WORDS distinct words or
MOST_TOKENS words, so that one task can hold it, however large the corpus; a longer text makes a block by itself. Blocks
are numbered by task and written before anything reads them, so that a task that runs again gives the same.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark import TaskContext

MOST_WORDS, MOST_TOKENS = 400_000, 4_000_000
#: Words in one row of a block's list.
ROW_WORDS = 20_000


class Codes(dict):
    """word -> its place, given at the first meeting."""

    def __missing__(self, word):
        self[word] = code = len(self)
        return code

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def packed(numbers: np.ndarray) -> bytes:
    """32-bit integers, compressed byte by byte of equal weight."""
    return zstandard.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def block_numbers():
    """The block ids of this task."""
    task = TaskContext.get()
    first = task.partitionId() << 32
    while True:
        yield first
        first += 1


def word_rows(words: list[bytes]):
    """(place of the first, words) of a block's rows."""
    for at in range(0, len(words), ROW_WORDS):
        yield at, words[at : at + ROW_WORDS]


def spread(start: np.ndarray, length: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of all codes one after another, the end of each); those of c are flat[start[c] : start[c] + length[c]]."""
    n = length[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start[codes] - (ends - n), n) + np.arange(total)], ends
