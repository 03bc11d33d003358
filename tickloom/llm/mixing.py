"""Mixing to target weights with soft membership.

A classifier learnt from a labelled table gives every document a posterior over domains. Document rates r >= 0 are
then found by projected-gradient least squares: the expected tokens of domain k, the sum of rate x tokens x posterior,
shall match its target. With rates measured in the square root of a document's tokens, a gradient step moves a rate by
the dot product of its posterior and the K residuals, so the state of the iteration is K numbers a step: a document's
rate follows from its posterior and the steps so far. The residuals are preconditioned with the inverse K x K Gram
matrix of the documents whose rate is above 0, so a rare domain takes no more steps than a common one. A step is one
pass over the written (tokens, posterior) table, which tries several lengths at once, and K and K x K sums a task.

The classifier is multinomial naive Bayes on hashed words, counted over at most ``FIT_ROWS`` labelled pairs (those of
smallest id hash; the bound makes them a broadcast, so no text is shuffled), with the log odds averaged over the
document and one temperature.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.llm.common import map_slices, raw_texts
from tickloom.session import stable

BUCKETS = 1 << 15
#: Longest domain list; posteriors and sums have so many numbers.
MAX_DOMAINS = 64
SMOOTHING = 0.5
#: Labelled (document, domain) pairs the classifier is fitted on.
FIT_ROWS = 20_000
#: Words that a text's averaged log odds stand for.
TEMPERATURE = 30.0
#: Steps after which the solver fails, largest distance of a share from its target.
STEPS, TOLERANCE = 300, 1e-4
#: Lengths of the preconditioned step that are tried, least relative fall of the squared residual by a step.
LENGTHS, GAIN = (1.0, 0.5, 0.25, 0.0625), 1e-3
SALT = 17

REMEMBERED = 400_000
_bucket: dict[bytes, int] = {}


def word_buckets(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Hash bucket of each lower-cased word; a worker remembers words."""
    out = []
    for word in text.lower().split():
        at = _bucket.get(word)
        if at is None:
            if len(_bucket) >= REMEMBERED:
                _bucket.clear()
            at = _bucket[word] = xxhash.xxh64_intdigest(word) & 0x7FFFFFFF
        out.append(at)
    return np.array(out, dtype=np.int64) % buckets


class Classifier:
    """Log odds per bucket and domain."""

    def __init__(self, domains: list[str], counts: np.ndarray, documents: np.ndarray, smoothing: float = SMOOTHING):
        self.domains = domains
        share = (counts + smoothing) / (counts.sum(axis=0) + smoothing * len(counts))
        self.weights = np.log(share) - np.log(share).mean(axis=1, keepdims=True)
        self.prior = np.log((documents + 1) / (documents + 1).sum())

    def posterior(self, text: bytes, temperature: float) -> np.ndarray:
        at = word_buckets(text, len(self.weights))
        score = self.prior + (temperature * self.weights[at].mean(axis=0) if len(at) else 0)
        odds = np.exp(score - score.max())
        return odds / odds.sum()


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS) -> Classifier | None:
    """From the ``fit_rows`` distinct non-null pairs of ``labels`` (doc_id, domain) of smallest hash; all their rows in ``docs`` (doc_id, text) are read.

    None without any labelled document. More than ``MAX_DOMAINS`` domains are refused.
    """
    marked = labels.select(F.col("doc_id").cast("long"), F.col("domain").cast("string")).dropna().distinct()
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(fit_rows)
    domains = [r.domain for r in marked.select("domain").distinct().limit(MAX_DOMAINS + 1).collect()]
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains.sort()
    if not domains:
        return None
    size = len(domains)
    place = {d: i for i, d in enumerate(domains)}
    by_id = marked.groupBy("doc_id").agg(F.collect_set("domain").alias("domains"))
    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(by_id), "doc_id").select("text", "domains")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.zeros((buckets + 1, size), dtype=np.int64)
        for text, own in zip(raw_texts(batch), batch.column("domains").to_pylist()):
            at = word_buckets(text, buckets)
            for domain in own:
                counts[:buckets, place[domain]] += np.bincount(at, minlength=buckets)
                counts[buckets, place[domain]] += 1
        row, column = np.nonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(row * size + column), pa.array(counts[row, column])], names=["cell", "n"])

    held = np.zeros((buckets + 1) * size, dtype=np.int64)
    for r in map_slices(known, work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        held[r.cell] = r.n
    held = held.reshape(buckets + 1, size)
    return Classifier(domains, held[:-1], held[-1]) if held[-1].any() else None


def posteriors(docs: DataFrame, model: Classifier, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, __tokens (words), __posterior (by domain) of ``docs`` (doc_id, text), in one pass."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("__tokens", T.LongType()), T.StructField("__posterior", T.ArrayType(T.DoubleType()))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw_texts(batch)
        found = [model.posterior(t, temperature) for t in texts]
        size = len(model.domains)
        lists = pa.ListArray.from_arrays(np.arange(0, size * len(found) + 1, size, dtype=np.int32), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.split()) for t in texts], pa.int64()), lists], names=schema.names)

    return map_slices(docs, work, schema)


def _rates(posterior: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The rate after the moves so far, from 1: rate <- max(0, rate - posterior . move)."""
    rate = np.ones(len(posterior))
    for move in moves:
        rate = np.maximum(0, rate - posterior @ move)
    return rate


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("__posterior").flatten().to_numpy().reshape(batch.num_rows, -1)


def solve(table: DataFrame, target: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(moves, shares reached) for the target shares, over ``table`` (__tokens, __posterior).

    Of the steps tried in a pass, the one of least residual is taken; one of them is the gradient step of 1 / the
    largest eigenvalue of the weighted Gram matrix of the posteriors, which never adds to the residual. Ends when all
    shares are within ``tolerance``, or when no step lowers the residual any more: then no rates reach the target, and
    the shares are the nearest. Still short of both after ``steps`` moves, it fails.
    """
    size = len(target)

    def sums(moves: np.ndarray, tries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens by domain after the moves and each try, and the Gram matrix of the rows with a rate above 0."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(tries), size + 1, size))
            for batch in batches:
                held, tokens = _matrix(batch), batch.column("__tokens").to_numpy().astype(float)
                before = _rates(held, moves)
                for one, move in zip(total, tries):
                    rate = np.maximum(0, before - held @ move)
                    one[0] += (tokens * rate) @ held
                    one[1:] += (held * (tokens * (rate > 0))[:, None]).T @ held
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

        rows = table.select("__tokens", "__posterior").mapInArrow(work, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(tries) * (size + 1) * size)
        for r in rows:
            out[r.k] = r.v
        out = out.reshape(len(tries), size + 1, size)
        return out[:, 0], out[:, 1:]

    moves = np.zeros((0, size))
    (tokens,), (gram,) = sums(moves, np.zeros((1, size)))
    total = tokens.sum()
    reached = tokens / max(total, 1)
    if not total:
        return moves, reached
    largest = np.linalg.eigvalsh(gram)[-1]

    def inverse(matrix: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(matrix)
        return vectors / np.maximum(values, 1e-9 * largest) @ vectors.T

    whole, active = inverse(gram), gram
    while np.abs(residual := reached - target).max() > tolerance:
        newton = total * inverse(active) @ residual
        tries = np.array([*(x * newton for x in LENGTHS), total * whole @ residual, total / largest * residual])
        tokens, grams = sums(moves, tries)
        left = ((tokens / total - target) ** 2).sum(axis=1)
        best = int(left.argmin())
        if left[best] > (1 - GAIN) * (residual @ residual):
            break
        if len(moves) >= steps:
            raise RuntimeError(f"shares {reached.tolist()} after {steps} steps, targets {target.tolist()}")
        moves = np.vstack([moves, tries[best]])
        reached, active = tokens[best] / total, grams[best]
    return moves, reached


class Mixture(NamedTuple):
    """A classifier and the moves of the rates; ``reached``: the shares of the expected tokens."""

    model: Classifier
    moves: np.ndarray
    reached: dict[str, float]
    temperature: float = TEMPERATURE


def _copies(ids: list, posterior: np.ndarray, rates: np.ndarray, salt: int) -> np.ndarray:
    """floor(rate), and one more with the chance of the rest, by a hash of id and posterior."""
    draws = np.array([xxhash.xxh64_intdigest(f"{i} {row.tobytes().hex()}", salt) >> 11 for i, row in zip(ids, posterior)], dtype=np.float64) / 2.0**53
    return np.floor(rates).astype(np.int64) + (draws < rates - np.floor(rates))


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **options: float) -> tuple[Mixture | None, DataFrame | None]:
    """The mixture of ``docs`` (doc_id, text) for ``targets`` (weights by domain, scaled to 1), and its written table
    (doc_id, __tokens, __posterior).

    A domain without label rows cannot be filled, and one without target gets none; where no rates reach the targets,
    a warning names the nearest shares, which are used. None without a labelled document.
    """
    model = fit(docs, labels)
    if model is None:
        return None, None
    weights = np.array([max(targets.get(d, 0.0), 0.0) for d in model.domains])
    if not weights.any():
        raise ValueError("no target for any labelled domain")
    table = stable(posteriors(docs.select(F.col("doc_id").cast("long"), "text"), model))
    target = weights / weights.sum()
    moves, reached = solve(table, target, **options)
    if reached.any() and np.abs(reached - target).max() > options.get("tolerance", TOLERANCE):
        warnings.warn(f"no rates reach the targets {dict(zip(model.domains, target.tolist()))}: shares are {dict(zip(model.domains, reached.tolist()))}", stacklevel=2)
    return Mixture(model, moves, dict(zip(model.domains, reached.tolist()))), table


SCHEMA = "doc_id long, n_tokens long, domain string, posterior double, rate double, copies long"


def report(docs: DataFrame, labels: DataFrame, targets: dict[str, float], salt: int = SALT, **options: float) -> DataFrame:
    """``SCHEMA``: tokens, likeliest domain with its posterior, rate and copies of every row of ``docs`` (doc_id, text).

    A row is drawn floor(rate) times, once more with the chance of the rest: the expected domain totals are those of
    the rates. Null and empty texts have no tokens and keep the prior; null ids and repeated rows are rows like any
    other. Without labelled documents the domain is null and every row is drawn once; an empty table gives no rows.
    """
    mix, table = mixture(docs, labels, targets, **options)
    if mix is None:
        words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
        return docs.select(F.col("doc_id").cast("long"), words.alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"),
                           F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    names = np.array(mix.model.domains)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _matrix(batch)
            rates = _rates(held, mix.moves)
            copies = _copies(batch.column("doc_id").to_pylist(), held, rates, salt)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__tokens"), pa.array(names[held.argmax(axis=1)].tolist(), pa.string()), pa.array(held.max(axis=1)),
                                              pa.array(rates), pa.array(copies)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return table.select("doc_id", "__tokens", "__posterior").mapInArrow(work, SCHEMA)


def drawn(docs: DataFrame, labels: DataFrame, targets: dict[str, float], salt: int = SALT, **options: float) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``report`` draws it, in one more pass over the texts."""
    mix, _ = mixture(docs, labels, targets, **options)
    if mix is None:
        return docs

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = np.array([mix.model.posterior(t, mix.temperature) for t in raw_texts(batch)])
        copies = _copies(batch.column("doc_id").cast(pa.int64()).to_pylist(), held, _rates(held, mix.moves), salt)
        return batch.take(pa.array(np.repeat(np.arange(batch.num_rows), copies)))

    return map_slices(docs, work, T.StructType(docs.schema.fields))


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the quality and toxicity marks: toxic, good or poor."""
    domain: Column = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


#: Production targets: shares of the expected tokens.
TARGETS = {"good": 0.85, "poor": 0.12, "toxic": 0.03}
