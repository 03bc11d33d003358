"""Token counts of a unigram vocabulary by a count-only Viterbi.

A text is cut into words at ASCII white space, each with the word mark before it, as the tokenizer does; pieces never
span words, so a text's count is the sum over its words. For a word an Aho-Corasick automaton lists the pieces that
end at each position, longest first, and the dynamic programme carries the best score, the number of pieces and
whether the last one is unknown: no path is kept. Ties go to the earliest start (the longest last piece), an unknown
character scores ``UNKNOWN_PENALTY`` below the worst piece, and neighbouring unknown characters are one piece.

Most words come again, so a worker remembers counts; the memory is bounded and only saves time. One pass, no shuffle.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import map_slices, raw_texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 600_000
LONGEST = 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a piece model: the score is the log of a Zipf share of the piece's rank."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = sum(1 / (rank + 2) for rank in range(len(ids)))
    # Rank by the model's own score, best first, then by id.
    order = sorted(ids, key=lambda i: (-model.get_score(i), i))
    return [(model.id_to_piece(i), math.log(1 / (rank + 2) / total)) for rank, i in enumerate(order)]


class Counter(dict):
    """Word (bytes) -> number of tokens."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        """Tokens of one marked word."""
        n = len(word)
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(word):
            ends[end].append(found)
        for end in range(n):
            at, top, single = -1, -math.inf, False
            for length, score in ends[end]:
                single |= length == 1
                total = best[end + 1 - length] + score
                if total > top or (total == top and end + 1 - length < at):
                    at, top = end + 1 - length, total
            if not single and best[end] + self.unknown > top:
                best[end + 1], unknown[end + 1] = best[end] + self.unknown, True
                pieces[end + 1] = pieces[end] + (not unknown[end])
            else:
                best[end + 1], pieces[end + 1] = top, pieces[at] + 1
        return pieces[n]

    def __missing__(self, word: bytes) -> int:
        n = self.count(MARK + word.decode("utf-8", "replace"))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of ``docs`` (doc_id, text) under the pieces of the file ``model``.

    Null and empty texts have none; a null doc_id stays null; repeated rows are counted one by one; an empty table
    gives no rows.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens_of = counter(model).__getitem__
        words = [text.split() for text in raw_texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(tokens_of, w)) for w in words], pa.int64())],
                                          names=["doc_id", "n_words", "n_tokens"])

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n_words long, n_tokens long")
