"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Each task takes the distinct pre-tokens of its documents and walks their trie depth first (their sorted order is that
walk, so only the path to the current node is held). The forward step of a prefix is computed once for all pre-tokens
that share it; the terminal node stores the number of pieces. A document's count is the sum over its pre-tokens.
Nothing is shuffled, and a lost task is simply run again.

For a unigram model the forward step is the unigram forward score; for a model of merges, whose encoding is not the
best sum of scores, it is the prefix's last piece (MergeCounter). Either gives the counts of the model's own encoding.
Characters without a piece count as their UTF-8 bytes.
Defined cases: a null or empty text has no tokens; a null doc_id is counted and stays null; long texts and pre-tokens are
counted whole; of pieces with equal scores the leftmost join comes first, as in the library; repeated rows are counted
each; extra columns, of whatever names, pass unread; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from attestra.llm.shared import texts_of

#: A pre-token is a run of spaces with what follows it up to the next space; the first one has a dummy space before it.
_PRE = re.compile("▁*[^▁\n]+|▁+|\n")
BATCH_CHARS, MEMO_WORDS = 4_000_000, 400_000
_worker: dict = {}


def pieces_of(path: str) -> dict[str, tuple[int, float]]:
    """Piece -> (id, score) of a sentencepiece model's normal pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): (i, model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


def is_unigram(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM


def pre_tokens(text: str) -> list[str]:
    return _PRE.findall("▁" + text.replace(" ", "▁")) if text else []


class TrieCounter:
    """counts(words): the number of tokens of each distinct word, from one walk of their trie."""

    def __init__(self, pieces: dict[str, tuple[int, float]]) -> None:
        self.scores = {p: s for p, (_, s) in pieces.items()}
        self.longest = max(map(len, self.scores), default=1)

    def start(self) -> None:
        """Begin a walk at the root."""
        raise NotImplementedError

    def back_to(self, depth: int) -> None:
        raise NotImplementedError

    def forward(self, word: str, end: int) -> None:
        """Go down to the node of word[:end] from its parent."""
        raise NotImplementedError

    def counts(self, words) -> dict[str, int]:
        out, before = {}, ""
        self.start()
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            self.back_to(shared)
            for end in range(shared + 1, len(word) + 1):
                self.forward(word, end)
            out[word] = self.number[len(word)]
            before = word
        return out


class UnigramCounter(TrieCounter):
    """Forward score of a prefix: the best sum of piece scores; number: the pieces of that path."""

    def start(self) -> None:
        self.unknown = min(self.scores.values(), default=0.0) - 10.0
        self.best, self.number = [0.0], [0]

    def back_to(self, depth: int) -> None:
        del self.best[depth + 1 :], self.number[depth + 1 :]

    def forward(self, word: str, end: int) -> None:
        get, best, number = self.scores.get, self.best, self.number
        top, pieces = None, 0
        for start in range(max(0, end - self.longest), end):  # ties: the longest piece, as it comes first
            score = get(word[start:end])
            if score is not None and (top is None or best[start] + score > top):
                top, pieces = best[start] + score, number[start] + 1
        if get(word[end - 1]) is None and (top is None or best[end - 1] + self.unknown > top):
            top, pieces = best[end - 1] + self.unknown, number[end - 1] + _n_bytes(word[end - 1])
        best.append(top)
        number.append(pieces)


class MergeCounter(TrieCounter):
    """For a table of merges, where the best sum of scores is not the encoding. A prefix's encoding has one last piece:
    the one that stays apart from the last piece of the prefix before it when the two are merged by themselves. So the
    forward step keeps each prefix's last piece and number of pieces instead of a score."""

    def start(self) -> None:
        if not hasattr(self, "apart"):
            self.apart: dict[tuple[str, str], bool] = {}
        self.last, self.number = [""], [0]

    def back_to(self, depth: int) -> None:
        del self.last[depth + 1 :], self.number[depth + 1 :]

    def forward(self, word: str, end: int) -> None:
        scores, apart, last = self.scores, self.apart, self.last
        for start in range(max(0, end - self.longest), end):
            piece = word[start:end]
            if piece in scores:
                pair = (last[start], piece)
                fits = apart.get(pair)
                if fits is None:
                    if len(apart) > MEMO_WORDS:
                        apart.clear()
                    fits = apart[pair] = self.merged(pair[0] + piece) == [x for x in pair if x]
                if fits:
                    last.append(piece)
                    self.number.append(self.number[start] + 1)
                    return
        last.append(word[end - 1])  # no piece: its bytes
        self.number.append(self.number[end - 1] + _n_bytes(word[end - 1]))

    def merged(self, text: str) -> list[str]:
        """Adjacent symbols are joined, the best-scored piece first, the leftmost of equals."""
        symbols, get = list(text), self.scores.get
        while True:
            best, at = None, 0
            for i, (a, b) in enumerate(zip(symbols, symbols[1:])):
                score = get(a + b)
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


def _n_bytes(char: str) -> int:
    return len(char.encode("utf-8", "surrogatepass"))


def counter_of(path: str) -> TrieCounter:
    return (UnigramCounter if is_unigram(path) else MergeCounter)(pieces_of(path))


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row."""

    def count(batches):
        counter = _worker.get(model)
        if counter is None:
            counter = _worker[model] = counter_of(model)
            counter.known = {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                    chars += len(texts[end])
                    end += 1
                words = [pre_tokens(t) for t in texts[at:end]]
                known = counter.known
                new = set().union(*words) - known.keys() if words else set()
                fresh = counter.counts(new)
                if len(known) + len(fresh) > MEMO_WORDS:
                    known = counter.known = {w: known[w] for x in words for w in x if w in known}
                known.update(fresh)
                n = [sum(map(known.__getitem__, w)) for w in words]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:end], pa.int64()), pa.array(list(map(len, words)), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])
                at = end

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
