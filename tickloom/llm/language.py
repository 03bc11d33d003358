"""Language identification by a blended-spectrum string kernel with Nystroem landmarks and kernel ridge regression.

A text is the set of its letter n-grams (n = 1, 2, 3; anything but letters is one separator), hashed into 2^18 buckets
an order. The kernel of two texts is the number of buckets in both, divided by the geometric mean of their sizes, all
counted over the buckets of the landmarks. Landmarks and fit rows are the rows of smallest id hash of each language
(two documented bounds); the ridge solution over the Nystroem features is found on the driver from those. A kernel
linear in presence lets landmarks and weights be multiplied out once, so a batch of texts is scored as presence
matrix x weight matrix.

Four scans (count labels; choose ids; sets of the chosen rows; predict), no shuffle of texts. What is sent to the tasks is bounded
by the landmarks: at most 3 x 2^18 buckets by languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.common import map_slices

ORDERS = 3
BITS = 18
#: Bounds of the fit, per language.
FIT_ROWS = 256
LANDMARKS = 32
RIDGE = 1e-2
#: More distinct labels than this are refused; it bounds what the driver reads.
MAX_LANGUAGES = 1000
#: Rows kept by the hash threshold for each one wanted, on average.
SPARE = 4
#: Texts whose presence rows are held at once.
BLOCK = 256
FOLDS, HELD_OUT = 4, 2

_fold: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for anything but a letter. Built once a worker."""
    if not _fold:
        chars = [chr(c) for c in range(0x110000)]
        low = [c.lower() if c.isalpha() else "\0" for c in chars]
        _fold.append(np.fromiter((ord(x) if len(x) == 1 else ord(c) for x, c in zip(low, chars)), dtype=np.uint32, count=len(chars)))
    return _fold[0]


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram, repeats included, and whether each text has a letter."""
    size = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(f"\0{t}\0" for t in texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    owner, letter = np.repeat(np.arange(len(texts)), size), _letters()[points]
    keep = (letter != 0) | np.r_[True, letter[:-1] != 0] | np.r_[True, owner[1:] != owner[:-1]]
    owner, letter = owner[keep], letter[keep]
    has = np.zeros(len(texts), dtype=bool)
    has[owner[letter != 0]] = True
    owners, buckets, mixed = [], [], np.zeros(len(letter), dtype=np.uint32)
    for n in range(1, ORDERS + 1):
        m = len(letter) - n + 1
        if m <= 0:
            break
        mixed = (mixed[:m] * np.uint32(0x9E3779B1)) ^ (letter[n - 1:] * np.uint32(0x85EBCA77))
        mixed ^= mixed >> np.uint32(15)
        inside = (owner[:m] == owner[n - 1:]) & ((n > 1) | (letter[:m] != 0))
        hashed = (mixed * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)
        owners.append(owner[:m][inside])
        buckets.append(hashed[inside].astype(np.int64) + ((n - 1) << BITS))
    return np.concatenate(owners or [np.zeros(0, np.int64)]), np.concatenate(buckets or [np.zeros(0, np.int64)]), has


def presence(owners: np.ndarray, buckets: np.ndarray, slot: np.ndarray, width: int, texts: int) -> np.ndarray:
    """0/1 matrix: which columns (``slot`` of a bucket, -1 for none) each text holds."""
    found = np.zeros((texts, width + 1), dtype=np.uint8)
    found.ravel()[owners * (width + 1) + slot[buckets]] = 1
    return found[:, :width].astype(np.float32)


class Model:
    """Languages, the column of each bucket, and the column weights of each language."""

    def __init__(self, languages: list[str], slot: np.ndarray, weights: np.ndarray):
        self.languages, self.slot, self.weights = languages, slot, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [], []
        for at in range(0, len(texts), BLOCK):
            part = [t or "" for t in texts[at:at + BLOCK]]
            owners, buckets, has = gram_buckets(part)
            if not self.languages:
                labels += ["und"] * len(part)
                scores += [0.0] * len(part)
                continue
            held = presence(owners, buckets, np.where(self.slot < 0, self.weights.shape[0], self.slot), self.weights.shape[0], len(part))
            value = (held @ self.weights) / np.sqrt(np.maximum(held.sum(axis=1), 1))[:, None]
            best = value.argmax(axis=1)
            sure = np.clip((value[np.arange(len(part)), best] + 1) / 2, 0, 1)
            labels += [self.languages[b] if h else "und" for b, h in zip(best, has)]
            scores += [float(s) if h else 0.0 for s, h in zip(sure, has)]
        return labels, scores


def solve(rows: list[tuple[str, np.ndarray]], landmarks: int, ridge: float) -> Model:
    """Nystroem features from the first ``landmarks`` rows of each language, one-versus-rest ridge over all rows."""
    languages = sorted({lang for lang, _ in rows})
    picked, seen = [], dict.fromkeys(languages, 0)
    for i, (lang, _) in enumerate(rows):
        if seen[lang] < landmarks:
            seen[lang] += 1
            picked.append(i)
    slot = np.full(ORDERS << BITS, -1, dtype=np.int32)
    if not languages:
        return Model([], slot, np.zeros((0, 0), dtype=np.float32))
    columns = np.unique(np.concatenate([rows[i][1] for i in picked]))
    slot[columns] = np.arange(len(columns))
    held = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for i, (_, own) in enumerate(rows):
        at = slot[own]
        held[i, at[at >= 0]] = 1
    held /= np.sqrt(np.maximum(held.sum(axis=1), 1))[:, None]
    marks = held[picked]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    project = vectors[:, good] / np.sqrt(values[good])
    features = (held @ marks.T).astype(np.float64) @ project
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in rows])
    beta = np.linalg.solve(features.T @ features + ridge * len(rows) * np.eye(features.shape[1]), features.T @ target)
    return Model(languages, slot, (marks.T @ (project @ beta)).astype(np.float32))


def fit(docs: DataFrame, label: str = "lang", fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model learnt from ``docs`` (doc_id, text, ``label``): rows without id, text or label are not used.

    The fit reads, per language, the ``fit_rows`` rows of smallest id hash. The driver gets their sets of buckets.
    """
    known = docs.select("doc_id", F.col(label).alias("language"), "text").filter("doc_id is not null and text is not null and language is not null")
    narrow = known.select("doc_id", "language", F.xxhash64("doc_id").alias("place"))
    sizes = {r.language: r["count"] for r in narrow.groupBy("language").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: {label} is no language column")
    if not sizes:
        return solve([], landmarks, ridge)
    # A hash threshold leaves some rows more than are wanted of each language, whatever the table's size; the exact
    # choice among them is then a window over a bounded group. An id counts once, however many rows it has.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, SPARE * fit_rows / n))])
    within = F.pmod(F.col("place"), F.lit(1 << 30)) < F.try_element_at(share, F.col("language")) * float(1 << 30)
    order = Window.partitionBy("language").orderBy("place", "doc_id")
    ids = narrow.filter(within).distinct().withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= fit_rows).select("doc_id").distinct().collect()

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        owners, buckets, has = gram_buckets(texts)
        each = np.unique(owners * (ORDERS << BITS) + buckets)
        cuts = np.searchsorted(each, np.arange(1, len(texts)) * (ORDERS << BITS))
        own = [(x % (ORDERS << BITS)).astype(np.int32) for x in np.split(each, cuts)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "language": batch.column("language"), "buckets": [x.tobytes() for x in own]}).filter(pa.array(has))

    # One row an id and label, whatever a hot id holds.
    rows = known.filter(F.col("doc_id").isin([r.doc_id for r in ids])).groupBy("doc_id", "language").agg(F.min("text").alias("text"))
    found = map_slices(rows, sets, "doc_id long, language string, buckets binary").collect()
    found = sorted(found, key=lambda r: (r.language, r.doc_id))
    return solve([(r.language, np.frombuffer(r.buckets, dtype=np.int32)) for r in found], landmarks, ridge)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text). Null or letterless texts are ``und``, 0."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels, scores = model.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(labels, pa.string()), "score": pa.array(scores, pa.float64())})

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, lang_pred string, score double")


def fold(doc_id: str = "doc_id"):
    """True for the ids that no fit may read; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows not held out, predicted for all.

    Repeated rows are predicted one by one, an empty table gives no rows, without any labelled row all is ``und``.
    """
    model = fit(docs.filter(~fold()))
    return predict(docs, model).select("doc_id", fold().alias("held_out"), "lang_pred", "score")
