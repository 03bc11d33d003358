"""Product-quantisation codes with exact integer distances, entries eliminated early in the Walsh-Hadamard domain.

Components become integers, vectors are cut into equal parts, and every part position has a codebook. Parts and
entries, padded with zeros to a power of two, go through the integer Walsh-Hadamard transform (butterflies of sums and
differences, rows in order of sequency). It keeps squared distances but for the factor of its length, and gathers what
the components have in common in the first coefficients. So the scaled squared differences are added coefficient by
coefficient: the entry that leads after the first one is measured in full, and an entry leaves as soon as its sum is
above the best full one. Integers throughout: nothing is rounded, ties go to the lower index.

A pass over the table a round. What meets on the driver is codebooks and their sums (parts x entries numbers).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.operators.series import small_side
from tickloom.session import stable

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors whose differences to all entries are held at once.
ROWS = 1024
#: Integers of a component and sums of squares up to here are kept in 64 bits; beyond, Python's own integers are used.
WIDE = 2**62


def sequency(size: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix of ``size`` (a power of two), by their number of sign changes."""
    i = np.arange(size)
    sign = np.bitwise_count(i[:, None] & i[None, :]) & 1
    return np.argsort((sign[:, 1:] != sign[:, :-1]).sum(axis=1), kind="stable")


def transform(parts: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard coefficients of the last axis, padded with zeros to a power of two, in order of sequency."""
    size = 1 << max(parts.shape[-1] - 1, 0).bit_length()
    out = np.zeros((*parts.shape[:-1], size), dtype=parts.dtype)
    out[..., : parts.shape[-1]] = parts
    half = 1
    while half < size:
        pairs = out.reshape(*out.shape[:-1], size // (2 * half), 2, half)
        one, two = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack([one + two, one - two], axis=-2).reshape(out.shape)
        half *= 2
    return out[..., sequency(size)]


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry, for ``parts`` (vector, part, n) and ``books`` (part, entry, n)."""
    reach = parts.shape[-1] * 2 * max(int(np.abs(parts).max(initial=0)), int(np.abs(books).max(initial=0)))
    if 2 * parts.shape[-1] * reach**2 >= WIDE:
        parts, books = parts.astype(object), books.astype(object)
    x, c = transform(parts), transform(books)
    count, width, entries, size = len(x), x.shape[1], c.shape[1], x.shape[-1]
    total = (x[:, :, None, 0] - c[None, :, :, 0]) ** 2
    lead = total.argmin(axis=2)
    led = c[np.arange(width)[None, :], lead]
    bound = ((x - led) ** 2).sum(axis=2)
    alive = np.flatnonzero(total.reshape(-1) <= np.repeat(bound.reshape(-1), entries))
    total = total.reshape(-1)[alive]
    for k in range(1, size):
        cell, entry = alive // entries, alive % entries
        part = cell % width
        total = total + (x[..., k].reshape(-1)[cell] - c[part, entry, k]) ** 2
        held = total <= bound.reshape(-1)[cell]
        alive, total = alive[held.astype(bool)], total[held.astype(bool)]
    # The leader itself stays, so every cell has an entry; the first least one of its run is taken.
    cell = alive // entries
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    least = np.minimum.reduceat(total, starts) if len(total) else total
    hits = np.flatnonzero((total == np.repeat(least, np.diff(np.r_[starts, len(cell)]))).astype(bool))
    first = hits[np.r_[True, cell[hits][1:] != cell[hits][:-1]]] if len(hits) else hits
    return (alive[first] % entries).reshape(count, width), (least // size).reshape(count, width)


def integers(batch: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept rows, values, lengths): floor(scale * x) of each component of the rows without null or non-finite ones."""
    lists = batch.cast(pa.large_list(pa.float64()))
    size = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    fine = flat.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(owner[~fine], minlength=len(size)) > 0
    kept = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & ~bad)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False)[~bad[owner]]
    if np.abs(values).max(initial=0) * scale < 2**53:
        return kept, np.floor(values * scale).astype(np.int64), size[kept]
    exact = [n * scale // d for n, d in (float(v).as_integer_ratio() for v in values)]
    return kept, np.array(exact, dtype=np.int64 if max(map(abs, exact)) < WIDE else object), size[kept]


def padded(values: np.ndarray, size: np.ndarray, width: int, parts: int) -> np.ndarray:
    """(vector, part, n) of the flat ``values`` of vectors of ``size``, zeros behind shorter ones."""
    out = np.zeros((len(size), width), dtype=values.dtype)
    out[np.arange(width)[None, :] < size[:, None]] = values
    return out.reshape(len(size), parts, width // parts)


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The kept rows of the batches and their parts, ``ROWS`` at most at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            kept, values, size = integers(rows.column("vector"), scale)
            if len(kept):
                yield rows.take(pa.array(kept)), padded(values, size, width, parts)


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """The codebooks (part, entry, n) of ``rows`` (vec_id, vector, label), after ``rounds`` of assignment and means."""
    x = F.col("vector")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.filter(fine)
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return np.zeros((parts, 0, 1), dtype=np.int64)
    width = max(1, math.ceil(longest / parts)) * parts
    order = (F.col("vec_id").isNull(), F.col("vec_id"), F.col("vector"), F.col("label").isNull(), F.col("label"))
    seeds = [r.vector for r in kept.orderBy(*order).limit(entries).select("vector").collect()]
    _, values, size = integers(pa.array(seeds, pa.list_(pa.float64())), scale)
    books = padded(values, size, width, parts).transpose(1, 0, 2)

    for _ in range(rounds):
        sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(width // parts)]
        found = rows.mapInArrow(_sums(books, scale, width, parts), "part int, entry int, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(width // parts)))
        books = books.astype(object)
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            books[r.part, r.entry] = [int(s) // r.n for s in r[3:]]
        if max(map(abs, books.flat)) < WIDE:
            books = books.astype(np.int64)
    return books


def _sums(books: np.ndarray, scale: int, width: int, parts: int):
    """Componentwise sums and counts of the parts of each entry: one set a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, deep = books.shape[1], width // parts
        count, total = np.zeros(parts * entries, dtype=np.int64), np.zeros((parts * entries, deep), dtype=object)
        for _, own in _blocks(batches, scale, width, parts):
            cell = (nearest(own, books)[0] + np.arange(parts) * entries).reshape(-1)
            flat = own.reshape(-1, deep)
            part = np.zeros((parts * entries, deep), dtype=flat.dtype if int(np.abs(flat).max(initial=0)) * len(flat) < WIDE else object)
            np.add.at(part, cell, flat)
            total += part
            count += np.bincount(cell, minlength=parts * entries)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(count[used]),
                 *[pa.array([int(v) for v in total[used, i]], pa.decimal128(38, 0)) for i in range(deep)]],
                names=["part", "entry", "n", *[f"s{i}" for i in range(deep)]])

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, *, id_column: str = "vec_id",
          vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that takes part.

    Null vectors and vectors holding null or non-finite components take no part. Codebooks start from the ``entries``
    smallest ids (null ids last; of rows with one id the smaller vector first); with fewer rows they are shorter.
    Vectors shorter than the longest one, and all where that is no multiple of ``parts``, end in zeros. Repeated rows
    are coded one by one, an empty table gives no rows. A code has two hex digits a part, so ``entries`` is at most 256. Components of any size are exact; an error beyond 64 bits fails
    the job, as the column cannot hold it.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"), F.col(label_column).alias("label"))
    books = learn(rows, parts, entries, rounds, scale)
    width = books.shape[0] * books.shape[2]
    label_type = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, own in _blocks(batches, scale, width, parts):
            index, error = nearest(own, books)
            yield pa.RecordBatch.from_arrays([held.column("vec_id"), held.column("label"), pa.array([bytes(r).hex() for r in index.astype(np.uint8)]),
                                              pa.array([int(e) for e in error.sum(axis=1)], pa.int64())], names=["vec_id", "label", "code", "error"])

    if books.shape[1] == 0:
        return rows.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
    coded = stable(rows.mapInArrow(run, f"vec_id long, label {label_type}, code string, error long"))
    # Few labels are broadcast, after counting them; more meet in a join that AQE splits where a label is hot.
    totals = stable(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    return (coded.join(small_side(totals), F.col("label").eqNullSafe(F.col("__label")), "inner")
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of ``codes`` with these parameters: every distance in full, vectors of one length that ``parts`` divides."""
    steps = [f"books0 as (select part, rn - 1 as entry, x from parts where rn <= {entries})"]
    for k in range(rounds + 1):
        steps.append(f"""assigned{k} as (
  select p.rn, p.part, arg_min(b.entry, (list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) as entry,
    min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as error
  from parts p join books{k} b on p.part = b.part group by p.rn, p.part)""")
        if k < rounds:
            steps.append(f"""means{k} as (
  select part, entry, list(floor_div order by i) as x from (
    select part, entry, i, cast((s - ((s % n) + n) % n) // n as bigint) as floor_div from (
      select p.part, a.entry, i, sum(p.x[i]) as s, count(*) as n
      from parts p join assigned{k} a on p.rn = a.rn and p.part = a.part, (select unnest(range(1, (select max(len(x)) from parts) + 1)) as i)
      group by p.part, a.entry, i)) group by part, entry
), books{k + 1} as (select b.part, b.entry, coalesce(m.x, b.x) as x from books{k} b left join means{k} m on b.part = m.part and b.entry = m.entry)""")
    return f"""
with kept as (
  select row_number() over (order by vec_id nulls last, embedding, label nulls last) as rn, vec_id, label,
    list_transform(embedding, lambda v: cast(floor({scale} * cast(v as double)) as bigint)) as q
  from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0
), parts as (
  select rn, part, list_slice(q, part * (len(q) // {parts}) + 1, (part + 1) * (len(q) // {parts})) as x from kept, (select unnest(range({parts})) as part)
), {', '.join(steps)}, coded as (
  select rn, string_agg(format('{{:02x}}', entry), '' order by part) as code, cast(sum(error) as bigint) as error from assigned{rounds} group by rn
), book as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from books{rounds}
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join kept using (rn), book
"""
