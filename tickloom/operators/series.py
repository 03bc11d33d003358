"""Ordered-series work that does not need a whole key inside one task.

A window partitioned by instrument puts that instrument's whole history into one task. When one
instrument holds a third of a table that task never ends, so every ordered operator here can run
on *blocks*: an exact 1-based position per key is computed from a range-sorted copy of the table,
rows are cut into fixed-size blocks of consecutive positions, and

* a frame of n rows gets the n-1 rows before its block as a copied margin (``framed``),
* a running aggregate gets one carry row per block (``running``),
* a linear recursion gets the decayed ends of the few blocks before it (``recursions``).

Blocks are the default. A caller that knows its keys to be small (``measured_layout`` counts them
on a base table) may ask for ``layout="plain"``, one exchange and one sort; both give the same rows,
those with NULL keys included: every join here is null-safe.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import stable

PLAIN_LIMIT = 2_000_000
BLOCK_ROWS = 100_000
SMALL_TABLE_ROWS = 200_000
POS = "_pos"
BLOCK = "_block"
HOME = "_home"
RUN = "_run_block"

Keys = Sequence[str]
Order = Sequence["str | Column"]


def as_columns(order: Order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def measured_layout(df: DataFrame, keys: Keys, limit: int = PLAIN_LIMIT) -> str:
    """For callers: ``plain`` if the largest key of a base table is small, else ``blocks``. One pre-aggregated count."""
    biggest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return "plain" if (biggest or 0) <= limit else "blocks"


def same_key_join(left: DataFrame, right: DataFrame, on: Keys, how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the result has the keys once, from ``left``."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    match = reduce(and_, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in on])
    return left.join(other, match, how).drop(*[f"_r_{k}" for k in on])


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast hint for an already materialised table, but only after counting it."""
    return F.broadcast(df) if df.count() <= SMALL_TABLE_ROWS else df


def positions(df: DataFrame, keys: Keys, order: Order, layout: str = "blocks", name: str = POS) -> DataFrame:
    """Append the exact 1-based position of each row inside its key.

    A table that already carries ``_pos`` is taken as it is, so several operators share one placing.
    """
    if name in df.columns:
        return df
    if layout == "plain":
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*as_columns(order))).cast("long"))
    # The row id only lets a run of equal rows be cut between tasks; any order among them will do.
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    sort = [F.col(k) for k in keys] + as_columns(order) + [F.col("_tie")]
    ranged = tied.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie")
    # The slot holds (task, row in task); the checkpoint fixes it, so a lost executor cannot renumber rows.
    fixed = stable(ranged.withColumn("_slot", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_slice", F.shiftright("_slot", 33))
    runs = fixed.groupBy(*keys, "_slice").agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = stable(runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    return (
        same_key_join(fixed, small_side(runs), [*keys, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_slot") - F.col("_first") + 1)
        .drop("_slot", "_slice", "_first", "_before")
    )


def placed_once(df: DataFrame, keys: Keys, order: Order, layout: str) -> DataFrame:
    """For several block operators in a row: their positions, found once. The plain layout needs none."""
    return positions(df, keys, order, layout) if layout == "blocks" else df


def framed(
    df: DataFrame,
    keys: Keys,
    order: Order,
    build: Callable[[DataFrame, object], DataFrame],
    *,
    back: int = 0,
    ahead: int = 0,
    layout: str = "blocks",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``build(df, window)`` where no frame reaches more than ``back``/``ahead`` rows."""
    if layout == "plain":
        return build(df, Window.partitionBy(*keys).orderBy(*as_columns(order)))
    # A block is longer than any frame, so a frame meets the next or the last block only.
    block_rows = max(block_rows, back, ahead)
    placed = positions(df, keys, order, "blocks")
    home = F.expr(f"({POS} - 1) div {block_rows}")
    within = F.expr(f"({POS} - 1) % {block_rows}")
    copies = [home]
    if back:
        copies.append(F.when(within >= block_rows - back, home + 1))
    if ahead:
        copies.append(F.when((within < ahead) & (home > 0), home - 1))
    spread = placed.withColumn(HOME, home).withColumn(BLOCK, F.explode(F.array_compact(F.array(*copies))))
    built = build(spread, Window.partitionBy(*keys, BLOCK).orderBy(POS))
    built = built.filter(F.col(HOME) == F.col(BLOCK)).drop(HOME, BLOCK)
    return built if POS in df.columns else built.drop(POS)


_IN_BLOCK = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "last": lambda c: F.last(c, ignorenulls=True),
    "previous": lambda c: F.last(c, ignorenulls=True),
}


def _merge(kind: str, carry: Column, own: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(carry + own)
    if kind == "max":
        return F.greatest(carry, own)
    if kind == "min":
        return F.least(carry, own)
    return F.coalesce(own, carry)


def running(
    df: DataFrame,
    keys: Keys,
    order: Order,
    specs: Mapping[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    layout: str = "blocks",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running sum / max / min / count / last non-NULL over all rows up to here.

    ``inclusive=False`` leaves the current row out; ``previous`` is the last non-NULL value before the row either way.
    ``specs`` maps an output name to ``(kind, value)``. A table that carries ``_run_block`` beside ``_pos`` keeps both, so
    several runs share one exchange and one sort.
    """
    end = 0 if inclusive else -1

    def reach(kind: str) -> int:
        return -1 if kind == "previous" else end

    if layout == "plain":
        w = Window.partitionBy(*keys).orderBy(*as_columns(order))
        return df.select("*", *[_IN_BLOCK[kind](value).over(w.rowsBetween(Window.unboundedPreceding, reach(kind))).alias(name) for name, (kind, value) in specs.items()])
    placed = positions(df, keys, order, "blocks")
    if RUN not in df.columns:
        placed = placed.withColumn(RUN, F.expr(f"({POS} - 1) div {block_rows}"))
    valued = placed.select("*", *[value.alias(f"_v_{name}") for name, (_, value) in specs.items()])
    totals = []
    for name, (kind, _) in specs.items():
        value = F.col(f"_v_{name}")
        if kind in ("last", "previous"):
            total = F.max_by(value, F.when(value.isNotNull(), F.col(POS)))
        else:
            total = _IN_BLOCK[kind](value)
        totals.append(total.alias(f"_t_{name}"))
    ends = valued.groupBy(*keys, RUN).agg(*totals)
    before = Window.partitionBy(*keys).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    carries = ends.select(
        *keys,
        RUN,
        *[
            _IN_BLOCK["sum" if kind == "count" else kind](F.col(f"_t_{name}")).over(before).alias(f"_c_{name}")
            for name, (kind, _) in specs.items()
        ],
    )
    # One row a block, written once: the rows meet it where they are instead of being shuffled to it.
    carries = small_side(stable(carries))
    inside = Window.partitionBy(*keys, RUN).orderBy(POS)
    local = valued.select("*", *[_IN_BLOCK[kind](F.col(f"_v_{name}")).over(inside.rowsBetween(Window.unboundedPreceding, reach(kind))).alias(name) for name, (kind, _) in specs.items()])
    joined = same_key_join(local, carries, [*keys, RUN])
    for name, (kind, _) in specs.items():
        joined = joined.withColumn(name, _merge(kind, F.col(f"_c_{name}"), F.col(name)))
    extra = [f"_{part}_{name}" for name in specs for part in ("v", "c")]
    joined = joined.drop(*extra) if RUN in df.columns else joined.drop(RUN, *extra)
    return joined if POS in df.columns else joined.drop(POS)


@dataclass(frozen=True)
class Recursion:
    """s = s + alpha*(x - s), seeded with the mean of ``seed_rows`` values from row ``start`` on.

    ``carry`` continues an earlier run: it holds that run's value on the last row of it and NULL elsewhere; ``skip`` is
    true on the rows up to there, which then only serve as context.
    """

    value: Column
    alpha: float
    start: int = 1
    seed_rows: int = 1
    carry: Column | None = None
    skip: Column | None = None

    @property
    def first(self) -> int:
        return self.start + self.seed_rows - 1


def _span(specs: Mapping[str, Recursion]) -> int:
    """Rows per sub-block such that no weight leaves the double range."""
    slowest = max(-math.log10(1.0 - s.alpha) for s in specs.values())
    return max(32, min(2048, int(120 / slowest)))


def recursions(
    df: DataFrame, keys: Keys, order: Order, specs: Mapping[str, Recursion], layout: str = "blocks", span: int | None = None
) -> DataFrame:
    """Evaluate linear recursions (EMA, Wilder, EWMA) with window sums only.

    Inside a sub-block s_i = d^i * sum(b_j * d^-j) with d = 1 - alpha; the state entering it is the
    sum of the ends of earlier sub-blocks, each decayed by whole sub-blocks. That sum is cut where
    the decay is below the smallest double, so nothing representable is lost. Rows before the seed
    is complete are NULL.
    """
    first = max(s.first for s in specs.values())
    if span is None and first > _span(specs) and len(specs) > 1:
        # A long seed needs long sub-blocks, in which a fast recursion would leave the double range: one at a time.
        placed = positions(df, keys, order, layout)
        for n, s in specs.items():
            placed = recursions(placed, keys, order, {n: s}, layout)
        return placed if POS in df.columns else placed.drop(POS)
    span = max(span or _span(specs), first)
    placed = positions(df, keys, order, layout)
    placed = placed.select("*", *[s.value.cast("double").alias(f"_x_{n}") for n, s in specs.items()])
    placed = placed.withColumn("_sub", F.expr(f"({POS} - 1) div {span}")).withColumn("_i", F.expr(f"({POS} - 1) % {span}"))
    base = Window.partitionBy(*keys, "_sub").orderBy(POS)
    running_rows = base.rowsBetween(Window.unboundedPreceding, 0)
    pos, i = F.col(POS), F.col("_i")
    for n, s in specs.items():
        x = F.col(f"_x_{n}")
        seed = F.avg(x).over(base.rowsBetween(-(s.seed_rows - 1), 0)) if s.seed_rows > 1 else x
        step = F.when(pos < s.first, F.lit(0.0)).when(pos == s.first, seed).otherwise(x * s.alpha)
        if s.carry is not None:
            step = F.when(s.carry.isNotNull(), s.carry).when(s.skip, F.lit(0.0)).otherwise(step)
        placed = placed.withColumn(f"_b_{n}", step)
    local = placed.select(
        "*",
        *[
            (F.pow(F.lit(1.0 - s.alpha), i) * F.sum(F.col(f"_b_{n}") * F.pow(F.lit(1.0 / (1.0 - s.alpha)), i)).over(running_rows)).alias(n)
            for n, s in specs.items()
        ],
    )
    reach = {n: max(1, math.ceil(330 / (-math.log10(1.0 - s.alpha) * span))) for n, s in specs.items()}
    ends = local.filter(i == span - 1).select(*keys, "_sub", *specs)
    carried = ends.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(max(reach.values())))))
    carried = carried.groupBy(*keys, (F.col("_sub") + F.col("_d")).alias("_sub")).agg(
        *[
            F.sum(F.when(F.col("_d") <= reach[n], F.col(n) * F.pow(F.lit(1.0 - s.alpha), (F.col("_d") - 1) * span))).alias(f"_c_{n}")
            for n, s in specs.items()
        ]
    )
    joined = same_key_join(local, carried, [*keys, "_sub"], "left")
    for n, s in specs.items():
        carry = F.coalesce(F.col(f"_c_{n}"), F.lit(0.0)) * F.pow(F.lit(1.0 - s.alpha), i + 1)
        joined = joined.withColumn(n, F.when(pos >= s.first, F.col(n) + carry))
    extra = [f"_{part}_{n}" for n in specs for part in ("x", "b", "c")]
    joined = joined.drop("_sub", "_i", *extra)
    return joined if POS in df.columns else joined.drop(POS)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Keys,
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    tie: Sequence[str] = (),
    *,
    prefix: str = "",
    layout: str = "blocks",
) -> DataFrame:
    """Latest right row at or before each left row, by a merge of both sides instead of a join.

    Right rows come first on equal times; ``tie`` orders right rows that share a time.
    """
    packed = F.struct(*[F.col(v) for v in values])
    blank_tie = [F.lit(None).cast(right.schema[t].dataType).alias(f"_tie{n}") for n, t in enumerate(tie)]
    left_part = left.select(
        *keys,
        F.col(left_ts).alias("_at"),
        F.lit(1).alias("_side"),
        *blank_tie,
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
        F.lit(None).alias("_hit"),
    )
    right_part = right.select(
        *keys, F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), *[F.col(t).alias(f"_tie{n}") for n, t in enumerate(tie)],
        F.lit(None).alias("_row"), packed.alias("_hit"),
    )
    merged = left_part.unionByName(right_part)
    order = ["_at", "_side", *[f"_tie{n}" for n in range(len(tie))]]
    seen = running(merged, keys, order, {"_found": ("last", F.col("_hit"))}, layout=layout)
    return seen.filter("_side = 1").select("_row.*", *[F.col(f"_found.{v}").alias(prefix + v) for v in values])
