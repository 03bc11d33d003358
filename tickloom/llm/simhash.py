"""SimHash near-duplicates by tiled exact comparison.

Rows with one fingerprint are one node (counted in partial aggregates, so a large group of copies is a row a task).
The distinct fingerprints are dealt into tiles by the population counts of their upper and lower half, at most
``TILE`` to a tile. Fingerprints that differ in r bits differ by r at most in the sum of both counts' differences, so
tile pairs beyond that are never formed; the others are compared in full (numpy exclusive-or and bit counts, rows of
one tile against the other). A tile pair returns a spanning forest of its links, never all pairs.

The forests meet in a distributed connected-components loop (alternating large and small stars) over written tables.
Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tickloom.llm.common import map_slices, raw_texts
from tickloom.session import stable

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 2048
#: Rows of one tile compared at once with the whole other tile.
ROWS = 256
#: Stands for a null doc_id; sorts after all others.
NO_ID = 2**63 - 1


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, as a signed number: a bit is set if it is set in over half of the shingles' XXH64. No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        digest = xxhash.xxh64_digest
        starts = [0, *ends[:-shingle].tolist()]
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp of every row of ``docs`` (doc_id, text); null texts have no words."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t, shingle, seed) for t in raw_texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, fp long")


def _tiles(points: DataFrame, tile: int) -> DataFrame:
    """tile (hi, lo, part), fps: the distinct fingerprints in arrays of about ``tile`` and the tiles of each cell."""
    cell = points.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"))
    parts = cell.groupBy("hi", "lo").count().select("hi", "lo", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    # 33 x 33 cells at most.
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")
    return cell.join(F.broadcast(parts), ["hi", "lo"]).select("hi", "lo", "parts", part, "fp").groupBy("hi", "lo", "parts", "part").agg(F.collect_list("fp").alias("fps"))


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, root) for every fingerprint linked within ``a`` (``b`` None) or between ``a`` and ``b``, roots left out."""
    own = b is None
    other = a if own else b
    # Counted as unsigned: of a negative number numpy counts the bits of its magnitude.
    bits, other_bits = a.view(np.uint64), other.view(np.uint64)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for at in range(0, len(a), ROWS):
        near = np.bitwise_count(bits[at:at + ROWS, None] ^ other_bits[None, :]) <= radius
        if own:
            near &= np.arange(len(other))[None, :] > np.arange(at, at + near.shape[0])[:, None]
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            continue
        near = near[rows]
        # Each row with its first column, each column with its first row, then the columns of a row in one group by label spreading.
        columns = np.flatnonzero(near.any(axis=0))
        near = near[:, columns]
        label = np.arange(len(rows))
        while True:
            by_column = np.where(near, label[:, None], len(rows)).min(axis=0)
            spread = np.where(near, by_column[None, :], len(rows)).min(axis=1)
            if (spread == label).all():
                break
            label = spread
        for i, group in enumerate(label):
            x, y = find(int(a[at + rows[i]])), find(int(a[at + rows[group]]))
            root[max(x, y)] = min(x, y)
        for j, group in enumerate(by_column):
            x, y = find(int(other[columns[j]])), find(int(a[at + rows[group]]))
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def links(points: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: spanning forests, by tile pair, of the links between the distinct fingerprints ``points`` (fp)."""
    tiles = stable(_tiles(points, tile))
    cells = tiles.select("hi", "lo", "parts").distinct()
    # One of each two opposite neighbours.
    offsets = [(h, low) for h in range(0, radius + 1) for low in range(-radius, radius + 1) if h + abs(low) <= radius and (h, low) >= (0, 0)]
    near = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(low).alias("l")) for h, low in offsets])).alias("d")
    pairs = (tiles.select("hi", "lo", "part", near)
             .select("hi", "lo", "part", (F.col("hi") + F.col("d.h")).alias("hi2"), (F.col("lo") + F.col("d.l")).alias("lo2"))
             .join(cells.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "parts"), ["hi2", "lo2"])
             .select("hi", "lo", "part", "hi2", "lo2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part2"))
             .filter("(hi, lo) != (hi2, lo2) or part <= part2"))
    left = tiles.select("hi", "lo", "part", F.col("fps").alias("one"))
    right = tiles.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("part").alias("part2"), F.col("fps").alias("two"))
    both = pairs.join(left, ["hi", "lo", "part"]).join(right, ["hi2", "lo2", "part2"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for r in range(batch.num_rows):
                one, two = (batch.column(c)[r].values.to_numpy() for c in ("one", "two"))
                same = all(batch.column(c)[r].as_py() == batch.column(c + "2")[r].as_py() for c in ("hi", "lo", "part"))
                found += forest(one, None if same else two, radius)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return both.select("hi", "lo", "part", "hi2", "lo2", "part2", "one", "two").mapInArrow(work, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of ``edges`` (a, b) but the roots themselves."""
    edges = stable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # large holds only (node, smaller node).
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = stable(large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct())


def _named(groups: DataFrame, radius: int, tile: int) -> DataFrame:
    """fp, first, root of ``groups`` (fp, first): the fingerprint that names the component of each."""
    roots = components(links(groups.select("fp"), radius, tile))
    return groups.join(roots, groups.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id reachable) of every row of ``docs`` (doc_id, text).

    Texts without words have fingerprint zero and link like any other. Null ids are no component's name unless all its
    ids are null. Repeated rows each give a row; an empty table gives none.
    """
    marked = stable(fingerprints(docs))
    named = _named(stable(marked.groupBy("fp").agg(F.min("doc_id").alias("first"))), radius, tile)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: one row, of its smallest doc_id.

    A null id stands for a component only if all its ids are null. Of several rows with that id and fingerprint the
    one of smallest text stays. The fingerprints are computed once more in the pass that reads the rows.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([fingerprint(t) for t in raw_texts(batch)], pa.int64())], names=schema.names)

    marked = fingerprints(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    named = _named(stable(marked.groupBy("fp").agg(F.min("doc_id").alias("first"))), radius, tile)
    heads = named.groupBy("root").agg(F.min(F.struct("first", "fp")).alias("head")).select(F.col("head.first").alias("__id"), F.col("head.fp").alias("__fp"))
    rows = map_slices(docs, work, schema).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    one = rows.withColumn("__turn", F.row_number().over(Window.partitionBy("__id", "__fp").orderBy("text"))).filter("__turn = 1")
    return one.join(heads, ["__id", "__fp"], "left_semi").select(docs.columns)
