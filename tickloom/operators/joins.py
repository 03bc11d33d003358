"""Join shapes of market data that stay linear in both inputs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.series import as_of, small_side
from tickloom.session import stable

# Rows of the crowded side that one key may hold in a task: what is copied for the parts is a hundredth of the pairs.
CROWD = 100
# Of a join that is all pairs: right rows held at a time, pairs a task makes, and cells of pairs dealt to a task.
PART_ROWS = 1_000
TASK_PAIRS = 50_000_000
TASK_CELLS = 8


def lookup(facts: DataFrame, dim: DataFrame, key: str | Sequence[str], *, outer: bool = False, missing: dict[str, object] | None = None) -> DataFrame:
    """Facts with the columns of a dimension; unknown keys dropped, or kept with ``missing`` values.

    No hint: the planner broadcasts the dimension when its measured size allows it.
    """
    joined = facts.join(dim, key if isinstance(key, str) else list(key), "left" if outer else "inner")
    return joined.fillna(missing) if missing else joined


def crowded_join(left: DataFrame, right: DataFrame, on: Sequence[str], rows: int = CROWD) -> DataFrame:
    """Inner join on few keys that many rows of ``right`` share: one key's pairs are made by many tasks.

    Right rows of a crowded key are dealt by their hash into parts of some ``rows`` rows, and each left row goes to all
    parts of its key. Parts are counted (an action on ``right``, which is not a stream); without a crowded key this is
    the plain join. Nothing behind the pairs is shuffled.
    """
    parts = stable(right.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts")))
    most, total = parts.agg(F.max("_parts"), F.sum("_parts")).first()
    if (most or 0) <= 1:
        return left.join(right, list(on))
    # More tasks than parts, so few parts fall together.
    tasks = min(3 * total, 4 * int(right.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = small_side(parts)
    # One type on both sides, whatever may be null in either.
    kind = T.StructType([T.StructField(c, right.schema[c].dataType) for c in on] + [T.StructField("_part", T.IntegerType())])
    place = F.struct(*on, "_part").cast(kind).alias("_place")
    spread = left.join(parts, list(on)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*on, *[c for c in left.columns if c not in on], place)
    dealt = right.withColumn("_hash", F.xxhash64(*right.columns)).join(parts, list(on)).withColumn("_part", F.expr("cast(pmod(_hash, _parts) as int)"))
    dealt = dealt.select(*[c for c in right.columns if c not in on], place)
    # The join stands on these exchanges: one key, equal counts. A stated count is not merged for being few bytes.
    return spread.repartition(tasks, "_place").join(dealt.repartition(tasks, "_place").hint("merge"), "_place").drop("_place")


def crowded_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], rows: int = PART_ROWS, most: int = TASK_PAIRS) -> DataFrame:
    """Inner join of two tables on few keys, for a result much larger than either: pairs are counted and cut into cells.

    Right rows of a key are dealt into parts of some ``rows`` rows, left rows into slices, so that a task makes some
    ``most`` pairs whichever side crowds on a key. A left row goes to all parts of its key and a right row to all its
    slices: a thousandth of the pairs is copied where parts are full. Both sides are fixed first, neither is a stream;
    without a crowded key this is the plain join. Nothing behind the pairs is shuffled.
    """
    counts = stable(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_right")))
    if (counts.agg(F.max("_right")).first()[0] or 0) <= CROWD:
        return left.join(right, list(on))
    partitions = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Numbered and fixed: equal rows are dealt too, and a task that runs again deals alike.
    met = left.join(small_side(counts), list(on)).drop("_right")
    left, right = (stable(df.withColumn("_row", F.monotonically_increasing_id())) for df in (met, right.repartition(partitions)))
    grid = stable(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_left")).join(counts, list(on)).withColumn("_key", F.monotonically_increasing_id()))
    pairs = grid.agg(F.sum(F.col("_left").cast("double") * F.col("_right"))).first()[0] or 0
    tasks = max(4 * partitions, math.ceil(pairs / most))
    parts, cell = F.ceil(F.col("_right") / rows), pairs / (TASK_CELLS * tasks) or 1
    # Slices of at least CROWD rows: what is copied for them is a hundredth of the pairs at most.
    slices = F.least(F.ceil(F.col("_left").cast("double") * F.col("_right") / parts / cell), F.ceil(F.col("_left") / CROWD))
    grid = small_side(grid.select(*on, "_key", parts.cast("int").alias("_parts"), slices.cast("int").alias("_slices")))

    def dealt(df: DataFrame, own: str, own_count: str, other: str, other_count: str) -> DataFrame:
        df = df.join(grid, list(on)).withColumn(own, F.expr(f"cast(pmod(xxhash64(_row), {own_count}) as int)"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1))).drop("_row", "_parts", "_slices")

    place = ["_key", "_slice", "_part"]
    spread = dealt(left, "_slice", "_slices", "_part", "_parts").repartition(tasks, *place)
    copied = dealt(right, "_part", "_parts", "_slice", "_slices").drop(*on).repartition(tasks, *place)
    return spread.join(copied.hint("merge"), place).drop(*place)


def interval_latest(
    spans: DataFrame, points: DataFrame, keys: Sequence[str], start: str, end: str, at: str, values: Sequence[str],
    *, slack_seconds: int = 1, tie: Sequence[str] = (), prefix: str = "", layout: str = "blocks",
) -> DataFrame:
    """Latest point within [start - slack, end + slack] of each span.

    That is the latest point at or before the end, kept only if it is not before the start, so an
    as-of merge replaces the range join and no span x point pairs are formed.
    """
    slack = F.make_dt_interval(secs=F.lit(slack_seconds))
    limited = spans.withColumn("_limit", F.col(end) + slack)
    found = as_of(limited, points.withColumn("_point", F.col(at)), keys, "_limit", at, ["_point", *values], tie, layout=layout)
    inside = F.col("_point") >= F.col(start) - slack
    kept = [F.when(inside, F.col(v)).alias(prefix + v) for v in values]
    return found.select(*spans.columns, *kept)


def first_match(left: DataFrame, right: DataFrame, on: Sequence[str], where: Column, order: Sequence[str], values: Sequence[str], prefix: str = "") -> DataFrame:
    """Left rows with the first right row (by ``order``) among those equal on ``on`` and passing ``where``.

    The right side is reduced to one row per key before the join, so the join cannot fan out.
    """
    best = right.filter(where).groupBy(*on).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_m"))
    return left.join(best, list(on), "left").select(*left.columns, *[F.col(f"_m.{v}").alias(prefix + v) for v in values])


def recent(df: DataFrame, ts: str, n: int, tie: str | None = None) -> DataFrame:
    """Newest n rows (a bounded heap per task, no full sort)."""
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    return df.orderBy(*order).limit(n)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row of each key, as one combining aggregate."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Latest version of each key over a table and its changes."""
    return latest_per(table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1))), keys, [version, "_new"]).drop("_new")


def stable_upsert(table: DataFrame, changes: DataFrame, natural: Sequence[str], identity: str) -> DataFrame:
    """Upsert on a natural key that keeps the id a row already has and takes all else from the change."""
    rest = [c for c in table.columns if c not in (*natural, identity)]
    old, new = table.alias("o"), changes.alias("n")
    joined = old.join(new, list(natural), "full")
    seen = F.col(f"n.{identity}").isNotNull()
    return joined.select(
        *natural,
        F.coalesce(F.col(f"o.{identity}"), F.col(f"n.{identity}")).alias(identity),
        *[F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest],
    )
