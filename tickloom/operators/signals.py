"""Signal generators: functions from a candle or feature table to signal rows.

The three baselines are pure window functions of closes. The three quantitative ones read the
feature table and give *candidates*: an entry direction for a flat position and an exit flag for an
open long; the ledger (``operators.ledger``) decides which one applies.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.stats import clamp, ratio
from tickloom.operators.features import KEYS, ORDER, as_doubles, ema, previous_known, sma, stddev
from tickloom.operators.joins import crowded_join, crowded_pairs
from tickloom.operators.series import framed, positions, recursions

LONG, SHORT, FLAT = "long", "short", "flat"


def direction(long: Column, short: Column) -> Column:
    return F.when(long, LONG).when(short, SHORT)


def _finish(df: DataFrame, kind: str, entry: Column, confidence: Column, exit_long: Column | None, metadata: Column) -> DataFrame:
    """``exit_long`` is None for strategies that never look at their position."""
    return df.select(
        *KEYS,
        F.lit(kind).alias("strategy_id"),
        F.col("close_time").alias("ts"),
        entry.alias("entry"),
        clamp(confidence).alias("confidence"),
        F.lit(exit_long is not None).alias("manages_exit"),
        F.coalesce(exit_long if exit_long is not None else F.lit(False), F.lit(False)).alias("exit_long"),
        F.to_json(metadata).alias("metadata"),
    )


def ema_crossover(candles: DataFrame, *, fast: int = 12, slow: int = 26, layout: str = "blocks") -> DataFrame:
    """Sign change of fast minus slow EMA; no warm-up, so bar two can fire."""
    bars = as_doubles(candles)
    placed = positions(bars, KEYS, ORDER, layout)
    scanned = recursions(placed, KEYS, ORDER, {"fast_ema": ema(F.col("close"), fast), "slow_ema": ema(F.col("close"), slow)}, layout)
    gap = F.col("fast_ema") - F.col("slow_ema")
    # The scan sums in another order than a one-by-one recursion; below this the two averages are equal.
    scanned = scanned.withColumn("diff", F.when(F.abs(gap) <= F.abs("slow_ema") * 1e-12, 0.0).otherwise(gap))
    ready = framed(scanned, KEYS, ORDER, lambda df, w: df.withColumn("prev_diff", F.lag("diff").over(w)), back=1, layout=layout)
    return crossover_rows(ready)


def crossover_rows(ready: DataFrame) -> DataFrame:
    entry = direction((F.col("prev_diff") <= 0) & (F.col("diff") > 0), (F.col("prev_diff") >= 0) & (F.col("diff") < 0))
    confidence = F.coalesce(ratio(F.abs("diff"), F.abs("slow_ema")), F.lit(0.0))
    return _finish(ready, "ema_crossover", entry, confidence, None, F.struct("fast_ema", "slow_ema"))


def momentum(candles: DataFrame, *, lookback: int = 10, threshold: float = 0.01, layout: str = "blocks") -> DataFrame:
    """Return over a window of ``lookback`` closes, that is lookback - 1 bars."""

    def build(df: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-(lookback - 1), 0)
        return df.withColumn("_first", F.when(F.count("close").over(frame) == lookback, F.first("close").over(frame)))

    ready = framed(as_doubles(candles), KEYS, ORDER, build, back=lookback, layout=layout)
    return momentum_rows(ready.withColumn("lookback_return", ratio(F.col("close") - F.col("_first"), F.col("_first"))), threshold)


def momentum_rows(ready: DataFrame, threshold: float = 0.01) -> DataFrame:
    r = F.col("lookback_return")
    strong = F.abs(r) >= threshold
    return _finish(
        ready, "momentum", direction(strong & (r > 0), strong & (r <= 0)), F.abs(r) / (threshold * 5), None,
        F.struct("lookback_return"),
    )


def mean_reversion(candles: DataFrame, *, window: int = 20, entry_z: float = 2.0, layout: str = "blocks") -> DataFrame:
    def build(df: DataFrame, w) -> DataFrame:
        return df.withColumns({"mean": sma(F.col("close"), w, window), "stddev": stddev(F.col("close"), w, window)})

    ready = framed(as_doubles(candles), KEYS, ORDER, build, back=window, layout=layout)
    return reversion_rows(ready.withColumn("z_score", ratio(F.col("close") - F.col("mean"), F.col("stddev"))), entry_z)


def reversion_rows(ready: DataFrame, entry_z: float = 2.0) -> DataFrame:
    z = F.col("z_score")
    far = F.abs(z) >= entry_z
    return _finish(
        ready, "mean_reversion", direction(far & (z <= 0), far & (z > 0)), F.abs(z) / (entry_z * 2), None,
        F.struct("z_score", "mean", "stddev"),
    )


def statistical_mean_reversion(
    features: DataFrame,
    *,
    entry_z: float = 2.0,
    exit_z: float = 0.5,
    overbought: float = 70.0,
    oversold: float = 30.0,
    max_autocorrelation: float = 0.3,
    layout: str = "blocks",
) -> DataFrame:
    z, rsi = F.col("zscore"), F.col("rsi")
    calm = F.col("autocorrelation") <= max_autocorrelation
    entry = direction(calm & (z <= -entry_z) & (rsi <= oversold), calm & (z >= entry_z) & (rsi >= overbought))
    leave = z.isNull() | (F.abs(z) <= exit_z)
    return _finish(
        features, "statistical_mean_reversion", entry, F.abs(z) / (entry_z * 2), leave, F.struct("zscore", "rsi", "autocorrelation")
    )


def quant_momentum(
    features: DataFrame, *, min_r2: float = 0.6, exit_r2: float = 0.3, min_relative_volume: float = 1.0, layout: str = "blocks"
) -> DataFrame:
    r2, slope = F.col("reg_r2"), F.col("reg_slope")
    ready = (r2 >= min_r2) & (F.col("relative_volume") >= min_relative_volume)
    leave = r2.isNull() | (r2 < exit_r2) | (slope <= 0)
    return _finish(
        features, "quant_momentum", direction(ready & (slope > 0), ready & (slope < 0)), r2, leave,
        F.struct("reg_slope", "reg_r2", "relative_volume"),
    )


def volatility_breakout(features: DataFrame, *, min_relative_volume: float = 1.5, layout: str = "blocks") -> DataFrame:
    """Expansion is against the latest earlier *known* bandwidth."""
    return breakout_rows(previous_known(features, "bandwidth", layout=layout), min_relative_volume)


def breakout_rows(known: DataFrame, min_relative_volume: float = 1.5) -> DataFrame:
    b = F.col("percent_b")
    ready = (F.col("bandwidth") > F.col("prev_bandwidth")) & (F.col("relative_volume") >= min_relative_volume)
    overshoot = F.when(b > 1, b - 1).when(b < 0, -b)
    leave = b.isNull() | b.between(0.0, 1.0)
    return _finish(
        known, "volatility_breakout", direction(ready & (b > 1), ready & (b < 0)), overshoot / 0.5, leave,
        F.struct("percent_b", "bandwidth", "prev_bandwidth", "relative_volume"),
    )


@dataclass(frozen=True)
class StrategyKind:
    kind: str
    category: str
    source: str
    directions: tuple[str, ...]
    generate: Callable[..., DataFrame]
    params: Mapping[str, float] = field(default_factory=dict)


CATALOG: dict[str, StrategyKind] = {
    k.kind: k
    for k in (
        StrategyKind("ema_crossover", "baseline", "candles", (LONG, SHORT), ema_crossover, {"fast": 12, "slow": 26}),
        StrategyKind("momentum", "baseline", "candles", (LONG, SHORT), momentum, {"lookback": 10, "threshold": 0.01}),
        StrategyKind("mean_reversion", "baseline", "candles", (LONG, SHORT), mean_reversion, {"window": 20, "entry_z": 2.0}),
        StrategyKind(
            "statistical_mean_reversion", "quantitative", "features", (LONG, SHORT, FLAT), statistical_mean_reversion,
            {"entry_z": 2.0, "exit_z": 0.5, "overbought": 70.0, "oversold": 30.0, "max_autocorrelation": 0.3},
        ),
        StrategyKind(
            "quant_momentum", "quantitative", "features", (LONG, SHORT, FLAT), quant_momentum,
            {"min_r2": 0.6, "exit_r2": 0.3, "min_relative_volume": 1.0},
        ),
        StrategyKind(
            "volatility_breakout", "quantitative", "features", (LONG, SHORT, FLAT), volatility_breakout, {"min_relative_volume": 1.5}
        ),
    )
}


def register(kind: StrategyKind) -> None:
    """Add a user strategy: any function from a candle or feature table to candidate rows."""
    if kind.kind in CATALOG:
        raise ValueError(f"strategy kind {kind.kind!r} is already registered")
    CATALOG[kind.kind] = kind


def catalog_table(spark: SparkSession) -> DataFrame:
    rows = [(k.kind, k.category, list(k.directions), {n: float(v) for n, v in k.params.items()}) for k in CATALOG.values()]
    return spark.createDataFrame(rows, "kind string, category string, directions array<string>, params map<string,double>")


def candidates(candles: DataFrame, features: DataFrame, kinds: Sequence[str] | None = None, layout: str = "blocks") -> DataFrame:
    """Candidate rows of several kinds; the feature table is computed once by the caller."""
    out = None
    for kind in kinds or list(CATALOG):
        if kind not in CATALOG:
            raise ValueError(f"unknown strategy kind {kind!r}; expected one of {sorted(CATALOG)}")
        entry = CATALOG[kind]
        part = entry.generate(candles if entry.source == "candles" else features, layout=layout)
        out = part if out is None else out.unionByName(part)
    return out


def emitted(rows: DataFrame) -> DataFrame:
    """Candidates that fire on a flat book, as signal rows."""
    return rows.filter(F.col("entry").isNotNull()).select(
        "strategy_id", *KEYS, "ts", F.col("entry").alias("direction"), "confidence", "metadata"
    )


def expand_instances(instances: DataFrame, instruments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(id, kind, symbols)`` rows to (instance x instrument), unmatched symbols, repeated ids."""
    exploded = instances.withColumn("symbol", F.explode("symbols")).drop("symbols")
    matched = exploded.join(instruments, "symbol")
    unmatched = exploded.join(instruments.select("symbol"), "symbol", "left_anti")
    repeated = instances.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return matched, unmatched, repeated


def dispatch(rows: DataFrame, instances: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Fan candidate rows out to the instances of their kind and instrument; the result is all their pairs."""
    owners = instances if allowed is None else instances.join(allowed.select("id"), "id", "left_semi")
    by_kind = rows.withColumnRenamed("strategy_id", "kind")
    paired = crowded_join if rows.isStreaming else crowded_pairs
    return paired(by_kind, owners.select("id", "kind", F.col("symbol").alias("instrument")), ["kind", "instrument"]).withColumnRenamed("id", "strategy_id")


def strategies_for_instrument(instances: DataFrame) -> DataFrame:
    """Reverse index: one row per (symbol, instance), so a crowded symbol is never one list."""
    return instances.select("symbol", F.col("id").alias("strategy_id")).distinct()


def compatibility(pairs: DataFrame) -> DataFrame:
    """First unmet requirement of each (strategy, instrument) row; NULL where the strategy fits.

    Rows carry ``asset_classes``/``required_kinds`` of the strategy and
    ``asset_class``/``available_kinds`` of the instrument.
    """
    missing = F.array_except("required_kinds", "available_kinds")
    reason = F.when(~F.array_contains(F.col("asset_classes"), F.col("asset_class")), F.concat(F.lit("asset_class:"), F.col("asset_class"))).when(
        F.size(missing) > 0, F.concat(F.lit("data_kind:"), F.element_at(missing, 1))
    )
    return pairs.withColumn("incompatible", reason)
