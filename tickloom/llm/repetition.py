"""Quality rules from repetition: maximal repeated runs of words, found in a suffix array.

A text's words are numbered; prefix doubling over the words (numpy, many texts at a time) gives the suffix array and,
from the ranks of each doubling, the longest common prefix (LCP) of neighbours. The deepest LCP interval a suffix lies
in is the longest repeat that starts there, so the union of the spans of all LCP intervals is the union of these. A
text fails if the union covers too much of it or if one repeat is too long.

One pass over the table, no shuffle. A slice of 4 MB of text is held at a time (one longer text is its own slice); the
memory is 8 bytes a word and doubling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tickloom.llm.common import map_slices, raw_texts

#: ASCII white space that separates words, and the characters counted as symbols (fixed values).
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: The method's own limits: repeats of at least so many words count, may cover so much, and be so long.
MIN_REPEAT = 8
MAX_COVERED = 0.3
MAX_LONGEST = 100

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, covered_fraction double, longest_repeat long")


def repeat_lengths(tokens: np.ndarray, ends: np.ndarray, at_least: int) -> np.ndarray:
    """For each position the length of the longest run of tokens that starts there and occurs elsewhere in its text too.

    ``tokens``: numbers that differ between texts; ``ends``: the end of each position's text. Lengths below ``at_least`` are 0.
    """
    n = len(tokens)
    longest = np.zeros(n, dtype=np.int64)
    if n < 2:
        return longest
    _, number, count = np.unique(tokens, return_inverse=True, return_counts=True)
    # A rank is the place of a group's first suffix in the suffix array.
    rank = (np.cumsum(count) - count)[number]
    ranks, tied, span = [rank], np.flatnonzero(count[number] > 1), 1
    while tied.size:
        after = tied + span
        follow = np.where(after < ends[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + follow
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        old, at = rank[tied], np.arange(len(tied))
        starts = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        rank = rank.copy()
        rank[tied] = old + np.maximum.accumulate(np.where(starts, at, 0)) - group
        ranks.append(rank)
        part = np.cumsum(starts) - 1
        tied = tied[np.bincount(part)[part] > 1]
        span *= 2
    floor = at_least.bit_length() - 1
    if floor >= len(ranks):
        return longest
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    same = ranks[floor][a] == ranks[floor][b]
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), dtype=np.int64)
    for level in reversed(range(len(ranks))):
        x, y, r = a + lcp, b + lcp, ranks[level]
        equal = (x < ends[a]) & (y < ends[b]) & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)])
        lcp += equal.astype(np.int64) << level
    lcp[lcp < at_least] = 0
    longest[a] = lcp
    longest[b] = np.maximum(longest[b], lcp)
    return longest


def _covered(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of each text (from ``starts``) inside the union of the spans."""
    n = len(lengths)
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(lengths)
    edge[: n] += lengths > 0
    np.subtract.at(edge, at + lengths[at], 1)
    inside = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
    return inside[np.r_[starts[1:], n]] - inside[starts]


def measures(texts: list[bytes], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The counts of each text and its repeats of at least ``min_repeat`` words."""
    numbers: dict[bytes, int] = {}
    words, sizes, chars, symbols, dup_lines = [], [], [], [], []
    for text in texts:
        own = text.split()
        words.extend(numbers.setdefault(w, len(numbers)) for w in own)
        sizes.append(len(own))
        bare = text.translate(None, SPACE)
        chars.append(len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace")))
        symbols.append(len(bare) - len(bare.translate(None, SYMBOLS)))
        lines = [line for line in text.split(b"\n") if line.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    size = np.array(sizes, dtype=np.int64)
    begin = np.cumsum(size) - size
    tokens = np.fromiter(words, dtype=np.int64, count=len(words)) + np.repeat(np.arange(len(texts)), size) * max(len(numbers), 1)
    lengths = repeat_lengths(tokens, np.repeat(begin + size, size), min(WINDOW, min_repeat))
    full = size > 0
    repeat, covered, longest = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
    if full.any():
        own = np.where(lengths >= min_repeat, lengths, 0)
        repeat[full] = _covered(np.where(lengths >= WINDOW, lengths, 0), begin[full])
        covered[full] = _covered(own, begin[full])
        longest[full] = np.maximum.reduceat(own, begin[full])
    return {"n_words": size, "word_chars": np.array(chars), "n_symbols": np.array(symbols), "n_dup_lines": np.array(dup_lines),
            "n_repeat_words": repeat, "covered": covered, "longest": longest}


def _judge(texts: list[bytes], min_words: int, min_repeat: int, max_covered: float, max_longest: int) -> dict[str, np.ndarray]:
    m = measures(texts, min_repeat)
    m["base_failed"] = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    m["fraction"] = m["covered"] / np.maximum(m["n_words"], 1)
    m["kept"] = ~m["base_failed"] & (m["fraction"] <= max_covered) & (m["longest"] <= max_longest)
    return m


def quality(docs: DataFrame, min_words: int = MIN_WORDS, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
            max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row of counts and verdict per row of ``docs`` (doc_id, text; other columns are not read).

    A null or empty text has no words and fails; a null doc_id stays null; repeated rows are judged one by one; an
    empty table gives no rows.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _judge(raw_texts(batch), min_words, min_repeat, max_covered, max_longest)
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").cast(pa.int64()), "n_words": m["n_words"], "word_chars": m["word_chars"].astype(np.int64),
            "n_symbols": m["n_symbols"].astype(np.int64), "n_dup_lines": m["n_dup_lines"].astype(np.int64), "n_repeat_words": m["n_repeat_words"],
            "base_failed": m["base_failed"], "kept": m["kept"], "covered_fraction": m["fraction"], "longest_repeat": m["longest"]})

    return map_slices(docs.select("doc_id", "text"), work, SCHEMA)


def passing(docs: DataFrame, min_words: int = MIN_WORDS, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
            max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns, in one pass."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_judge(raw_texts(batch), min_words, min_repeat, max_covered, max_longest)["kept"]))

    return map_slices(docs, work, T.StructType(docs.schema.fields))
