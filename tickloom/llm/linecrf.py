"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's evidence is what it looks like (shares of capitals, symbols, repeated
words and so on, in fixed bins) and what the lines before and after it look like; neighbouring states are tied by a
transition matrix. Forward-backward gives each line's chance of being good; a document's score is their mean, weighted
by length.

Messages are products of 2 x 2 matrices, so all texts of a slice run at once: a prefix scan in logarithmically many
numpy steps, where the matrix of a text's first line has equal rows and so forgets all before it. The backward messages
are the forward ones of the reversed lines. Lines go through the scan in blocks that hand a vector on, so a text of
millions of lines needs no more room than its lines' features.

Lines have no labels of their own: those of a labelled document start with the document's. Between rounds of the fit,
lines of bad documents that the model takes for good become good, as long as one bad line is left.

The fit reads a bounded sample (documented below) on the driver; scoring is one pass over the table, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.common import map_slices

#: Bounds of the fit: rows of smallest id hash of each label, lines of one text, lines in all of each label.
FIT_ROWS = 1500
FIT_TEXT_LINES = 500
FIT_LINES = 10_000
#: Rows kept by the hash threshold for each one wanted, on average.
SPARE = 4
FOLDS = 5
ROUNDS = 2
STEPS = 60
RATE = 0.2
RIDGE = 1e-6
CUT = 0.3
#: Lines in one scan.
BLOCK = 1 << 16
#: The log-odds of one line are held within this.
REACH = 30.0

#: Kinds of characters.
SPACE, LOW, UPPER, DIGIT, POINT, SHOUT, SYMBOL, OTHER = range(8)
POINTS = ".,;:'\"-()?¿¡«»’“”…–—"
SHARES = np.array([1e-9, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
WORD_LENGTHS = np.array([1.0, 2.0, 3.5, 5.0, 6.5, 8.0, 12.0])
WORD_COUNTS = np.array([1, 2, 4, 8, 16, 32, 64])
BINS = 8
FEATURES = 14

_kinds: list[np.ndarray] = []
#: Multipliers of a word's characters in its hash.
_MIX = np.random.default_rng(5).integers(1, 2**63, 4096, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _kind() -> np.ndarray:
    """Code point below 2^16 -> kind of character. Built once a worker."""
    if not _kinds:
        def of(c: str) -> int:
            if c.isspace():
                return SPACE
            if c.isalpha():
                return UPPER if c.isupper() else LOW
            if c.isdigit():
                return DIGIT
            return SHOUT if c == "!" else POINT if c in POINTS else OTHER if not c.isprintable() else SYMBOL

        _kinds.append(np.array([of(chr(c)) for c in range(1 << 16)], dtype=np.uint8))
    return _kinds[0]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, code points of each line, bins of each line's features)."""
    kind_of = _kind()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kind_of[np.minimum(points, (1 << 16) - 1)]
    breaks = np.flatnonzero(points == 10)
    starts, ends = np.r_[0, breaks + 1], np.r_[breaks, len(points)]
    n, size = len(starts), ends - starts

    def per_line(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag, dtype=np.int64)]
        return total[ends] - total[starts]

    count = [per_line(kind == k) for k in range(8)]
    solid = np.maximum(size - count[SPACE], 1)
    inside = kind != SPACE
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.searchsorted(starts, begin, side="right") - 1
    words = np.bincount(line, minlength=n)
    many = np.maximum(words, 1)
    length = end - begin
    if len(begin):
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        letters = np.add.reduceat(((kind[inside] == LOW) | (kind[inside] == UPPER)).astype(np.int32), first)
        hashed = np.add.reduceat(points[inside].astype(np.uint64) * _MIX[place % len(_MIX)], first)
    else:
        letters = hashed = np.zeros(0, dtype=np.int64)

    def of_words(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(at[flag], minlength=n) / many

    again = [of_words((hashed[k:] == hashed[:-k]) & (line[k:] == line[:-k]), line[k:]) for k in (1, 2)]
    copies = np.zeros(n, dtype=np.uint8)
    held, at = [], 0
    for text in texts:
        own = text.split("\n")
        held.append(len(own))
        if len(own) > 1:
            seen: set[str] = set()
            for i, row in enumerate(own, at):
                if row in seen:
                    copies[i] = BINS - 1
                elif row:
                    seen.add(row)
        at += len(own)
    shares = [count[UPPER] / np.maximum(count[UPPER] + count[LOW], 1), count[DIGIT] / solid, count[POINT] / solid, count[SHOUT] / solid, count[SYMBOL] / solid,
              count[OTHER] / solid, *again, of_words(letters == 0, line), of_words(kind[end - 1] >= SHOUT, line), of_words(length <= 3, line)]
    bins = np.empty((n, FEATURES), dtype=np.uint8)
    for f, share in enumerate(shares):
        bins[:, f] = np.searchsorted(SHARES, share, side="right")
    bins[:, 11] = np.searchsorted(WORD_LENGTHS, np.bincount(line, weights=length, minlength=n) / many, side="right")
    bins[:, 12] = np.searchsorted(WORD_COUNTS, words, side="right")
    bins[:, 13] = copies
    return np.array(held, dtype=np.int64), size, bins


def _forward(weights: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Messages (line, state), each scaled to a sum of 1: ``weights`` (line, state), ``start`` marks first lines."""
    out = np.empty_like(weights)
    carry = np.ones(2)
    for at in range(0, len(weights), BLOCK):
        w, s = weights[at:at + BLOCK], start[at:at + BLOCK]
        p = np.where(s[:, None, None], 1.0, move) * w[:, None, :]
        p /= p.reshape(-1, 4).max(axis=1)[:, None, None]
        ids = np.arange(len(w))
        since = ids - np.maximum.accumulate(np.where(s, ids, 0))
        step, reach = 1, int(since.max())
        while step <= reach:
            rows = np.flatnonzero(since >= step)
            one, two = p[rows - step], p[rows]
            made = one[:, :, :1] * two[:, :1, :] + one[:, :, 1:] * two[:, 1:, :]
            p[rows] = made / made.reshape(-1, 4).max(axis=1)[:, None, None]
            step *= 2
        got = carry[0] * p[:, 0, :] + carry[1] * p[:, 1, :]
        out[at:at + BLOCK] = got / got.sum(axis=1, keepdims=True)
        carry = out[at + len(w) - 1]
    return out


def messages(odds: np.ndarray, lines: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward with the line's own weight, chance of good) of each line.

    ``odds``: log-odds of good by the line alone; ``lines``: of each text; ``move[i, j]``: weight of state j after i.
    """
    half = np.clip(odds, -REACH, REACH) / 2
    weights = np.exp(np.stack([-half, half], axis=1))
    last = np.cumsum(lines) - 1
    start, end = np.zeros(len(odds), dtype=bool), np.zeros(len(odds), dtype=bool)
    start[last - lines + 1] = True
    end[last] = True
    ahead = _forward(weights, start, move)
    back = _forward(weights[::-1], end[::-1], move.T)[::-1]
    both = ahead * back / weights
    return ahead, back, both[:, 1] / both.sum(axis=1)


class Model:
    """Weights of bins of the line itself, the line before and the line after, a bias, and log weights of transitions."""

    def __init__(self) -> None:
        self.tables = np.zeros((3, FEATURES * BINS))
        #: Bias, first line of a text, last line.
        self.edges = np.zeros(3)
        self.moves = np.zeros((2, 2))

    def odds(self, bins: np.ndarray, lines: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.edges[0])
        last = np.cumsum(lines) - 1
        first = last - lines + 1
        out[first] += self.edges[1]
        out[last] += self.edges[2]
        for at in range(0, len(bins), BLOCK):
            cell = bins[at:at + BLOCK] + np.arange(FEATURES) * BINS
            own, before, after = (t[cell].sum(axis=1) for t in self.tables)
            out[at:at + BLOCK] += own
            # The line behind sees this one as the line before, and the line ahead as the line after.
            room = out[at + 1:at + 1 + len(cell)]
            room += before[: len(room)]
            out[max(at - 1, 0):at + len(cell) - 1] += after[1 if at == 0 else 0:]
        # No line stands before a first or after a last one.
        out[first[1:]] -= self._seen(1, bins[first[1:] - 1])
        out[last[:-1]] -= self._seen(2, bins[last[:-1] + 1])
        return out

    def _seen(self, table: int, bins: np.ndarray) -> np.ndarray:
        return self.tables[table][bins + np.arange(FEATURES) * BINS].sum(axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The length-weighted chance of good of each text; an empty one is one empty line."""
        lines, size, bins = line_features(texts)
        good = messages(self.odds(bins, lines), lines, np.exp(self.moves))[2]
        first = np.cumsum(lines) - lines
        weight = size + 1.0
        return np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0, 1)


def train(lines: np.ndarray, bins: np.ndarray, quality: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> Model:
    """The field of labelled texts: their lines, the lines' bins, labels 0 or 1 and weights. Adam on the likelihood."""
    model = Model()
    if not len(lines):
        return model
    owner = np.repeat(np.arange(len(lines)), lines)
    last = np.cumsum(lines) - 1
    first = last - lines + 1
    inner = np.flatnonzero(np.r_[False, owner[1:] == owner[:-1]])
    cell = bins + np.arange(FEATURES) * BINS
    each = (weight / weight.mean())[owner]
    scale = each.sum()
    state = quality[owner].astype(np.int64)
    value = np.zeros(3 * FEATURES * BINS + 3 + 4)
    mean, square = np.zeros_like(value), np.zeros_like(value)
    turn = 0

    def summed(at: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return np.bincount(cell[at].ravel(), weights=np.repeat(rest, FEATURES), minlength=FEATURES * BINS)

    for own_round in range(rounds):
        for _ in range(steps):
            turn += 1
            move = np.exp(model.moves)
            ahead, back, good = messages(model.odds(bins, lines), lines, move)
            rest = (state - good) * each
            pair = ahead[inner - 1][:, :, None] * move * back[inner][:, None, :]
            pair *= (each[inner] / pair.sum(axis=(1, 2)))[:, None, None]
            seen = np.bincount(state[inner - 1] * 2 + state[inner], weights=each[inner], minlength=4)
            slope = np.concatenate([summed(slice(None), rest), summed(inner - 1, rest[inner]), summed(inner, rest[inner - 1]),
                                    [rest.sum(), rest[first].sum(), rest[last].sum()], seen - pair.sum(axis=0).ravel()]) / scale - RIDGE * value
            mean = 0.9 * mean + 0.1 * slope
            square = 0.99 * square + 0.01 * slope**2
            value = value + RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
            model.tables, model.edges, model.moves = value[:-7].reshape(3, -1), value[-7:-4], value[-4:].reshape(2, 2)
        if own_round + 1 < rounds:
            good = messages(model.odds(bins, lines), lines, np.exp(model.moves))[2]
            least = np.minimum.reduceat(good, first)[owner]
            state = np.where(quality[owner] == 1, 1, (good > 0.5) & (good > least)).astype(np.int64)
    return model


def fold(doc_id: str = "doc_id"):
    """True for the ids whose labels no fit may read; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, text_lines: int = FIT_TEXT_LINES, fit_lines: int = FIT_LINES) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1).

    Of each label the ``fit_rows`` ids of smallest hash are read, texts of at most ``text_lines`` lines, in that order
    up to ``fit_lines`` lines; they count as much as all ids of their label. Null ids, null or other labels and null
    texts are not used. An id with both labels counts as 0; of an id's texts the smallest counts.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("place", F.xxhash64("doc_id"))
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if not sizes:
        return Model()
    share = F.create_map(*[F.lit(x) for q, n in sizes.items() for x in (q, min(1.0, SPARE * fit_rows / n))])
    within = F.pmod(F.col("place"), F.lit(1 << 30)) < F.try_element_at(share, F.col("quality")) * float(1 << 30)
    order = Window.partitionBy("quality").orderBy("place", "doc_id")
    chosen = known.filter(within).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= fit_rows).select("doc_id", "quality", "place")
    # Broadcast by its bound of 2 x fit_rows ids.
    rows = (docs.select(F.col("doc_id").cast("long"), "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
            .filter(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < text_lines)
            .groupBy("doc_id", "quality", "place").agg(F.min("text").alias("text")))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, _, bins = line_features(batch.column("text").to_pylist())
        first = np.cumsum(lines) - lines
        own = [bins[a:a + n].tobytes() for a, n in zip(first, lines)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "place": batch.column("place"), "bins": pa.array(own, pa.binary())})

    found = sorted(map_slices(rows, features, "doc_id long, quality int, place long, bins binary").collect(), key=lambda r: (r.quality, r.place, r.doc_id))
    lines, bins, quality, weight = [], [], [], []
    for label, n in sizes.items():
        own, held = [], 0
        for r in found:
            if r.quality == label:
                held += len(r.bins) // FEATURES
                if held > fit_lines and own:
                    break
                own.append(np.frombuffer(r.bins, dtype=np.uint8).reshape(-1, FEATURES))
        lines += [len(b) for b in own]
        bins += own
        quality += [label] * len(own)
        weight += [n / len(own)] * len(own) if own else []
    return train(np.array(lines, dtype=np.int64), np.concatenate(bins) if bins else np.zeros((0, FEATURES), np.uint8), np.array(quality), np.array(weight))


def predict(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs`` (doc_id, text). A null text is an empty one: one empty line."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.scores([t or "" for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": score, "predicted": pa.array((score >= cut).astype(np.int32))})

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from labels of rows not held out, predicted for all.

    Repeated rows are scored one by one, an empty table gives no rows; without any label all scores are 0.5. Columns
    other than those named are not read. A text of any length is scored whole.
    """
    model = fit(docs, labels.filter(~fold()))
    return predict(docs, model, cut).select("doc_id", fold().alias("held_out"), "score", "predicted")
