"""How well do grid features predict forward returns?

Samples are long rows (key..., feature, horizon, ts, x, y). All statistics are grouped by
key, feature and horizon; ordered ones use exact positions, never a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.draws import REPLICATES, next_starts, replicate_states
from tickloom.functions.stats import pearson, ratio
from tickloom.operators.series import POS, positions, running, same_key_join
from tickloom.session import stable

# Features with a direction flag, default horizons, and the cost model.
FEATURES = (
    ("spread_abs", False),
    ("spread_pct", False),
    ("mid_price", False),
    ("microprice_deviation", True),
    ("bid_ask_imbalance", True),
    ("book_imbalance", True),
    ("trade_imbalance", True),
    ("volume_delta", True),
    ("trade_intensity", False),
    ("order_flow_imbalance", True),
)
HORIZONS = (1, 5, 15, 30, 60, 300)
TAKER_FEE = 0.001
SLIPPAGE_BPS = 3.0
GROUP_ROWS = 200_000


def unpivot_features(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., feature, is_directional, x), NULL features left out."""
    wide = rows.withColumn("microprice_deviation", F.col("microprice") - F.col("mid_price"))
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(d).alias("is_directional"), F.col(n).cast("double").alias("x")) for n, d in FEATURES])
    return wide.select(*keep, F.explode(pairs).alias("_f")).select(*keep, "_f.*").filter("x IS NOT NULL")


def forward_returns(grid: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("symbol",), ts: str = "timestamp_ms", version: Sequence[str] = ()) -> DataFrame:
    """Grid rows with ``horizon`` and the return ``y`` to exactly that much later.

    The later side is one thin row per time and horizon, so the wide grid is shuffled once whatever
    the number of horizons. Repeated times: the last row by ``version`` wins on the later side.
    """
    if any(h <= 0 for h in horizons):
        raise ValueError("horizons must be positive")
    last = F.max_by("mid_price", F.struct(*version)) if version else F.max("mid_price")
    later = grid.groupBy(*keys, ts).agg(last.alias("_later"))
    later = later.filter("_later IS NOT NULL").withColumn("horizon", F.explode(F.array(*[F.lit(int(h)).cast("long") for h in horizons])))
    later = later.select(*keys, (F.col(ts) - F.col("horizon") * 1000).alias(ts), "horizon", "_later")
    base = grid.filter("mid_price IS NOT NULL AND mid_price <> 0")
    mid = F.col("mid_price")
    return base.join(later, [*keys, ts]).withColumn("y", (F.col("_later") - mid) / mid).drop("_later")


def samples(grid: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("symbol",), ts: str = "timestamp_ms", version: Sequence[str] = ()) -> DataFrame:
    returns = forward_returns(grid, horizons, keys, ts, version)
    return unpivot_features(returns, [*keys, ts, "horizon", "y"])


def group_keys(keys: Sequence[str]) -> list[str]:
    return [*keys, "feature", "horizon"]


def basic_statistics(long: DataFrame, keys: Sequence[str] = ("symbol",), step_seconds: int = 1) -> DataFrame:
    """Everything that is one combining aggregate: n, effective n, Pearson, hit rate."""
    x, y = F.col("x"), F.col("y")
    counted = (x != 0) & (y != 0)
    hits = F.count_if(counted & (F.signum(x) == F.signum(y)))
    steps = F.greatest(F.expr(f"horizon div {step_seconds}"), F.lit(1))
    return long.groupBy(*group_keys(keys), "is_directional").agg(
        F.count(F.lit(1)).alias("n"),
        pearson(x, y).alias("pearson"),
        ratio(hits.cast("double"), F.count_if(counted).cast("double")).alias("_hits"),
    ).withColumns(
        {
            "n_effective": F.greatest(F.floor(F.col("n") / steps), F.lit(1)),
            "hit_rate": F.when(F.col("is_directional"), F.col("_hits")),
        }
    ).drop("_hits")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, layout: str = "blocks") -> DataFrame:
    """1-based ranks where ties share their mean rank.

    Ranks come from counts of distinct values, so ties shrink before anything is sorted.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    ranked = running(counts, keys, [value], {"_below": ("sum", F.col("_ties"))}, inclusive=False, layout=layout)
    rank = F.coalesce(F.col("_below"), F.lit(0)) + (F.col("_ties") + 1) / 2.0
    return same_key_join(df, ranked.select(*keys, value, rank.cast("double").alias(out)), [*keys, value])


def spearman(long: DataFrame, keys: Sequence[str] = ("symbol",), layout: str = "blocks") -> DataFrame:
    g = group_keys(keys)
    # Ranks of both sides are joined back to the samples.
    long = stable(long.select(*g, "x", "y"))
    ranked = average_ranks(average_ranks(long, g, "x", "_rx", layout), g, "y", "_ry", layout)
    return ranked.groupBy(*g).agg(pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], layout: str) -> DataFrame:
    """Positions and group sizes ``_n``; in the plain layout both come from one exchange."""
    if layout == "plain":
        return positions(df, keys, order, layout).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return same_key_join(positions(df, keys, order, layout), sizes, list(keys))


def deciles(long: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "timestamp_ms", layout: str = "blocks") -> DataFrame:
    """Mean y of ten slices [d*n/10, (d+1)*n/10) in x order (time breaks ties); groups of ten or more."""
    g = group_keys(keys)
    placed = _placed(long, g, ["x", ts], layout).filter("_n >= 10")
    # Smallest d with p <= (d+1)*n/10 in integer division, for the 1-based position p.
    slice_ = F.expr(f"(10 * {POS} - 1) div _n")
    means = [F.avg(F.when(F.col("_d") == d, F.col("y"))).alias(f"decile_{d + 1}") for d in range(10)]
    out = placed.withColumn("_d", slice_).groupBy(*g).agg(*means)
    return out.withColumn("decile_spread", F.col("decile_10") - F.col("decile_1"))


def split_half(long: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "timestamp_ms", layout: str = "blocks") -> DataFrame:
    """Pearson of the first floor(n/2) samples in time and of the rest."""
    g = group_keys(keys)
    placed = _placed(long, g, [ts], layout)
    early = F.col(POS) <= F.expr("_n div 2")

    def half(cond: Column) -> Column:
        return pearson(F.when(cond, F.col("x")), F.when(cond, F.col("y")))

    out = placed.groupBy(*g).agg(F.first("_n").alias("_n"), half(early).alias("_a"), half(~early).alias("_b"))
    enough = F.expr("_n div 2 >= 2 AND _n - _n div 2 >= 2")
    first, second = F.when(enough, F.col("_a")), F.when(enough, F.col("_b"))
    return out.select(
        *g, first.alias("first_half"), second.alias("second_half"),
        F.when((first != 0) & (second != 0), F.signum(first) == F.signum(second)).alias("stable_sign"),
    )


def round_trip_cost(grid: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Two fees, the mean spread once and two slippages."""
    return grid.groupBy(*keys).agg(
        (F.coalesce(F.avg("spread_pct"), F.lit(0.0)) + 2 * TAKER_FEE + 2 * SLIPPAGE_BPS / 10_000).alias("round_trip_cost"),
        F.count(F.lit(1)).alias("grid_points"),
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], layout: str = "blocks") -> DataFrame:
    """Linear-interpolated percentiles at index p*(n-1), from exact positions."""
    known = df.filter(F.col(value).isNotNull())
    placed = _placed(known.select(*keys, value), keys, [value], layout)
    parts = []
    for name, p in points.items():
        index = F.lit(p) * (F.col("_n") - 1)
        weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col(POS) - 1 - index))
        parts.append(F.sum(F.when(weight > 0, F.col(value) * weight)).alias(name))
    return placed.groupBy(*keys).agg(*parts)


# --- moving-block bootstrap -------------------------------------------------------------------
def _correlations(sums: np.ndarray, n: int) -> np.ndarray:
    """Pearson of replicates from their sums of x, y, xx, yy, xy (NaN where constant)."""
    sx, sy, sxx, syy, sxy = sums
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    flat = (vx <= 1e-12 * np.maximum(sxx, 1e-300)) | (vy <= 1e-12 * np.maximum(syy, 1e-300))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(flat, np.nan, (sxy - sx * sy / n) / np.sqrt(vx * vy))


def _interval(r: np.ndarray) -> tuple[float | None, float | None]:
    r = r[~np.isnan(r)]
    if len(r) < REPLICATES // 2:
        return None, None
    low, high = np.percentile(r, [2.5, 97.5])
    return float(low), float(high)


def _bootstrap_group(pdf: pd.DataFrame, keys: list[str], block: int) -> pd.DataFrame:
    """One bounded group: block sums from prefix sums, all replicates side by side."""
    pdf = pdf.sort_values("_t", kind="stable")
    n = len(pdf)
    block = min(max(block, 1), n)
    x, y = pdf["x"].to_numpy() - pdf["x"].mean(), pdf["y"].to_numpy() - pdf["y"].mean()
    prefix = np.concatenate([np.zeros((5, 1)), np.cumsum([x, y, x * x, y * y, x * y], axis=1)], axis=1)
    count = -(-n // block)
    tail = n - (count - 1) * block
    whole, partial = prefix[:, block:] - prefix[:, : n - block + 1], prefix[:, tail:] - prefix[:, : n - tail + 1]
    states = replicate_states(count, 0, REPLICATES)
    sums = np.zeros((5, REPLICATES))
    for k in range(count):
        states, starts = next_starts(states, n - block)
        sums += (whole if k < count - 1 else partial)[:, starts]
    low, high = _interval(_correlations(sums, n))
    row = {k: [pdf[k].iloc[0]] for k in keys}
    return pd.DataFrame({**row, "ci95_low": [low], "ci95_high": [high]})


def _draws(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Block starts of a few replicates of one group, in bounded pieces."""
    for pdf in batches:
        for row in pdf.to_dict("records"):
            n, block = int(row["_n"]), int(row["_block"])
            count = -(-n // block)
            states = replicate_states(count, int(row["_from"]), int(row["_reps"]))
            names = np.arange(row["_from"], row["_from"] + row["_reps"])
            piece: list[pd.DataFrame] = []
            for k in range(count):
                states, starts = next_starts(states, n - block)
                size = block if k < count - 1 else n - (count - 1) * block
                piece.append(pd.DataFrame({"_rep": names, "_start": starts, "_size": size}))
                if len(piece) == 1000 or k == count - 1:
                    yield pd.concat(piece).assign(**{key: row[key] for key in keys})[[*keys, "_rep", "_start", "_size"]]
                    piece = []


def _bootstrap_joined(long: DataFrame, g: list[str], sizes: DataFrame, ts: str) -> DataFrame:
    """Groups of any size: draws joined to prefix sums, both spread over the cluster."""
    means = long.groupBy(*g).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    centred = long.join(means, g).withColumns({"x": F.col("x") - F.col("_mx"), "y": F.col("y") - F.col("_my")}).drop("_mx", "_my")
    x, y = F.col("x"), F.col("y")
    parts = {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    placed = positions(centred, g, [ts], "blocks")
    sums = running(placed, g, [POS], {name: ("sum", value) for name, value in parts.items()}, layout="blocks")
    prefix = sums.select(*g, F.col(POS).alias("_at"), *parts)
    chunk = 25
    plan = sizes.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - chunk), F.lit(chunk)))).withColumn("_reps", F.lit(chunk))
    types = {f.name: f.dataType.simpleString() for f in sizes.schema.fields}
    ddl = ", ".join(f"`{k}` {types[k]}" for k in g) + ", _rep bigint, _start bigint, _size bigint"
    drawn = plan.repartition(*g, "_from").mapInPandas(lambda it: _draws(it, g), ddl)
    # Each draw reads the prefix at its two ends; +1 / -1 makes that one equi-join.
    ends = drawn.withColumn("_e", F.explode(F.array(F.struct((F.col("_start") + F.col("_size")).alias("at"), F.lit(1.0).alias("w")), F.struct(F.col("_start").alias("at"), F.lit(-1.0).alias("w")))))
    ends = ends.select(*g, "_rep", F.col("_e.at").alias("_at"), F.col("_e.w").alias("_w")).filter("_at > 0")
    ends = ends.groupBy(*g, "_rep", "_at").agg(F.sum("_w").alias("_w"))
    totals = ends.join(prefix, [*g, "_at"]).groupBy(*g, "_rep").agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in parts])
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("_n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("_n")
    flat = (vx <= F.col("sxx") * 1e-12) | (vy <= F.col("syy") * 1e-12)
    r = F.when(~flat, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("_n")) / F.sqrt(vx * vy))
    scored = totals.join(sizes.select(*g, "_n"), g).select(*g, r.alias("_r"))
    valid = F.count("_r") >= REPLICATES // 2
    # A thousand replicates per group: a bounded list.
    return scored.groupBy(*g).agg(
        F.when(valid, F.percentile("_r", F.lit(0.025))).alias("ci95_low"), F.when(valid, F.percentile("_r", F.lit(0.975))).alias("ci95_high")
    )


def block_bootstrap(
    long: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "timestamp_ms", step_seconds: int = 1, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """95 % interval of Pearson from 1000 moving-block replicates; groups of eight or more.

    Groups of at most ``group_rows`` samples (more than two days of one-second points) are each
    handled in a task; larger ones go through the joined form.
    """
    g = group_keys(keys)
    block = F.greatest(2 * F.greatest(F.expr(f"horizon div {step_seconds}"), F.lit(1)), F.lit(2))
    sizes = long.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 8").withColumn("_block", F.least(block, F.col("_n")).cast("long"))
    small, large = sizes.filter(F.col("_n") <= group_rows), sizes.filter(F.col("_n") > group_rows)
    rows = long.select(*g, F.col(ts).alias("_t"), "x", "y").join(small, g)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"`{k}` {types[k]}" for k in g) + ", ci95_low double, ci95_high double"
    near = rows.groupBy(*g).applyInPandas(lambda pdf: _bootstrap_group(pdf, g, int(pdf["_block"].iloc[0])), ddl)
    if large.limit(1).count() == 0:
        return near
    return near.unionByName(_bootstrap_joined(long.join(large.select(*g), g, "left_semi"), g, large, ts))


def analyze(
    grid: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("symbol",), ts: str = "timestamp_ms", step_seconds: int = 1, layout: str = "blocks"
) -> DataFrame:
    """All features x horizons of every key: one statistics row each."""
    g = group_keys(keys)
    # Five statistics read the samples; the join behind them runs once.
    returns = stable(forward_returns(grid, horizons, keys, ts))
    long = unpivot_features(returns, [*keys, ts, "horizon", "y"])
    out = basic_statistics(long, keys, step_seconds)
    for part in (
        spearman(long, keys, layout), deciles(long, keys, ts, layout), split_half(long, keys, ts, layout), block_bootstrap(long, keys, ts, step_seconds),
    ):
        out = out.join(part, g, "left")
    return out.join(round_trip_cost(grid, keys), list(keys)).withColumn("edge_exceeds_cost", F.abs("decile_spread") > F.col("round_trip_cost"))
