"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks.

Components become integers. Candidates and queries are each cut into blocks of bounded size. A pair of blocks turns
its candidates into postings, one list of (candidate, weight) per component that is not zero, and every query row
scatters its weighted postings into a dense array of integer scores; a partition selection keeps the best k of each
query, and the lists of all blocks are merged. Every query meets every candidate exactly once.

A block is a few hundred kilobytes in one row; what is shuffled is blocks of candidates x blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.session import stable

K = 20
SCALE = 64
QUERY_EVERY = 20
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """row, vec_id, vector (array<long>) of the rows that take part: floor(scale * x) of finite components, x as double.

    Null vectors and vectors holding null or non-finite components take no part. Every other row is a vector of its own
    (``row``), also where ids repeat or are null. Missing components of shorter vectors are zero. Components whose
    integer is beyond 64 bits fail the job.
    """
    x = F.col(vector_column).cast("array<double>")
    fine = F.col(vector_column).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def whole(v):
        return F.when(F.abs(v * scale) < float(2**63), F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))

    rows = vectors.filter(fine).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, whole).alias("vector"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _blocks(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row a block: rows and ids (ascending, nulls last) and the components of its vectors, padded to the longest, as binary."""

    def work(group: pa.Table) -> pa.Table:
        known = group.column("vec_id").is_valid().to_numpy()
        ids, own = group.column("vec_id").fill_null(0).to_numpy(), group.column("row").to_numpy()
        order = np.lexsort((ids, ~known))
        vectors = [group.column("vector")[int(i)].values.to_numpy(zero_copy_only=False) for i in order]
        width = max(map(len, vectors))
        held = np.zeros((len(ids), max(width, 1)), dtype=np.int64)
        for r, v in enumerate(vectors):
            held[r, : len(v)] = v
        small = held.astype(np.int16) if -(2**15) <= held.min(initial=0) and held.max(initial=0) < 2**15 else held
        return pa.table({name: group.column("block").slice(0, 1), f"{name}_own": [own[order].tobytes()], f"{name}_ids": [ids[order].tobytes()],
                         f"{name}_known": pa.array([int(known.sum())], pa.int32()), f"{name}_rows": [small.tobytes()], f"{name}_width": pa.array([max(width, 1)], pa.int32()), f"{name}_bytes": pa.array([small.itemsize], pa.int32())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(work, f"{name} int, {name}_own binary, {name}_ids binary, {name}_known int, {name}_rows binary, {name}_width int, {name}_bytes int")


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer scores (query, candidate), one component at a time: the non-zero query rows scatter that component's postings.

    Sums that might leave 64 bits are taken in Python's integers; a score that does fails the job.
    """
    width = min(queries.shape[1], candidates.shape[1])
    reach = width * max(map(abs, (int(queries.min(initial=0)), int(queries.max(initial=0))))) * max(map(abs, (int(candidates.min(initial=0)), int(candidates.max(initial=0)))))
    kind = np.int32 if reach < 2**31 else np.int64 if reach < 2**63 else object
    scores = np.zeros((len(queries), len(candidates)), dtype=kind)
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    room = np.empty(len(candidates), dtype=kind)
    for term in range(width):
        weights = candidates[:, term]
        posted = np.flatnonzero(weights)
        dense = 2 * len(posted) > len(weights)
        weights = np.ascontiguousarray(weights) if dense else weights[posted]
        for q in np.flatnonzero(queries[:, term]):
            if dense:
                # Most candidates are posted: the list is the whole column, zeros add nothing.
                scores[q] += np.multiply(weights, queries[q, term], out=room)
            else:
                scores[q, posted] += weights * queries[q, term]
    if kind is object:
        if scores.size and max(abs(scores.min()), abs(scores.max())) >= 2**63:
            raise OverflowError("a score is beyond 64 bits")
        scores = scores.astype(np.int64)
    return scores


def best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of each query's k best by score, then earlier candidate. ``own``: the query's own candidate, or -1.

    Selected by score; of those equal to the k-th score the earlier ones are taken.
    """
    taking = np.ones(scores.shape, dtype=bool)
    there = np.flatnonzero(own >= 0)
    taking[there, own[there]] = False
    if scores.shape[1] > k + 1:
        # The own row counts as lowest; with k + 1 others it is never the k-th.
        ranked = scores.copy()
        ranked[there, own[there]] = np.iinfo(scores.dtype).min
        least = np.partition(ranked, ranked.shape[1] - k, axis=1)[:, ranked.shape[1] - k][:, None]
        above, equal = (ranked > least) & taking, (ranked == least) & taking
        taking = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1)[:, None]))
    return np.nonzero(taking)


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, **columns: str) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every`` its k best other rows, ties to the smaller id.

    See ``quantised`` for rows that take no part. Rows with one id are queries and candidates each by itself; null ids
    are candidates only, and come last among ties. With fewer candidates than k, all are returned; an empty table gives
    no rows.
    """
    rows = stable(quantised(vectors, **columns))
    asked = rows.filter(F.col("vec_id") % every == 0)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    n_queries, n_blocks = max(1, -(-sizes.q // query_block)), max(1, -(-sizes.n // candidate_block))
    one = _blocks(asked, n_queries, "q")
    many = _blocks(rows, n_blocks, "c").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    # Pairs of blocks, dealt evenly: by their number, not by a key of the data.
    both = many.join(one, "q").withColumn("pair", F.col("q") * n_blocks + F.col("c"))
    pairs = n_queries * n_blocks
    if pairs > 1:
        # A pair a task, up to 16 pairs (10 MB) where there are very many.
        both = both.repartition(max(min(pairs, 2000), -(-pairs // 16)), "pair")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                side = {}
                for s in ("q", "c"):
                    width, item = (batch.column(f"{s}_{x}")[r].as_py() for x in ("width", "bytes"))
                    side[s] = (*(np.frombuffer(batch.column(f"{s}_{x}")[r].as_py(), np.int64) for x in ("own", "ids")),
                               np.frombuffer(batch.column(f"{s}_rows")[r].as_py(), np.int16 if item == 2 else np.int64).reshape(-1, width))
                (q_rows, q_ids, q_values), (c_rows, c_ids, c_values) = side["q"], side["c"]
                order = np.argsort(c_rows)
                spot = order[np.minimum(np.searchsorted(c_rows, q_rows, sorter=order), len(c_rows) - 1)]
                scores = accumulate(q_values, c_values)
                query, at = best(scores, np.where(c_rows[spot] == q_rows, spot, -1), k)
                unknown = at >= batch.column("c_known")[r].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[query]), pa.array(q_ids[query]), pa.array(c_ids[at], mask=unknown), pa.array(scores[query, at].astype(np.int64))],
                                                 names=["query", "query_id", "vec_id", "score"])

    found = both.mapInArrow(work, "query long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL of the registered query.
SQL = """
with valid as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda v: cast(floor(64 * cast(v as double)) as bigint)) as vector from embeddings
  where embedding is not null and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0
), scored as (
  select q.r, q.vec_id as query_id, c.vec_id,
    cast(coalesce(list_sum(list_transform(list_zip(q.vector, c.vector), lambda z: cast(z[1] as hugeint) * z[2])), 0) as bigint) as score
  from valid q join valid c on q.vec_id % 20 = 0 and q.r <> c.r
), ranked as (
  select query_id, cast(row_number() over (partition by r order by score desc, vec_id nulls last) as integer) as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
