"""Causal candle indicators: every frame ends at the current row.

``feature_series`` computes all families over one placing of the table. Each family is also a
function of ``(df, window)`` so that callers can pick a subset and a period.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.stats import ratio
from tickloom.operators.series import POS, Recursion, framed, positions, recursions, running, same_key_join
from tickloom.session import stable

KEYS = ("instrument", "timeframe")
ORDER = ("close_time",)


@dataclass(frozen=True)
class FeatureConfig:
    """The default indicator periods."""

    return_periods: tuple[int, ...] = (1, 5, 15, 60)
    sma_period: int = 20
    ema_period: int = 20
    stddev_period: int = 20
    realized_volatility_period: int = 20
    ewma_lambda: float = 0.94
    zscore_period: int = 20
    bollinger_period: int = 20
    bollinger_k: float = 2.0
    atr_period: int = 14
    rsi_period: int = 14
    roc_period: int = 12
    regression_period: int = 20
    autocorrelation_period: int = 20
    autocorrelation_lag: int = 1
    relative_volume_period: int = 20

    @property
    def reach(self) -> int:
        return max(
            *self.return_periods, self.sma_period, self.stddev_period, self.realized_volatility_period + 1,
            self.zscore_period, self.bollinger_period, self.roc_period, self.regression_period,
            self.autocorrelation_period + self.autocorrelation_lag + 1, self.relative_volume_period,
        )


def gated(expr: Column, value: Column, frame, n: int) -> Column:
    """NULL until the frame holds n values."""
    return F.when(F.count(value).over(frame) == n, expr)


def rolling_stats(value: Column, w, n: int) -> dict[str, Column]:
    """sum, mean, population deviation, first and last of the latest n rows (as available)."""
    frame = w.rowsBetween(-(n - 1), 0)
    return {
        "roll_sum": F.sum(value).over(frame),
        "roll_mean": F.avg(value).over(frame),
        "roll_stddev": F.stddev_pop(value).over(frame),
        "roll_first": F.first(value).over(frame),
        "roll_last": F.last(value).over(frame),
    }


def returns(close: Column, w, periods: Sequence[int]) -> dict[str, Column]:
    return {f"ret_{p}": ratio(close, F.lag(close, p).over(w)) - 1.0 for p in periods}


def sma(close: Column, w, n: int) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return gated(F.avg(close).over(frame), close, frame, n)


def stddev(close: Column, w, n: int) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return gated(F.stddev_pop(close).over(frame), close, frame, n)


def zscore(close: Column, w, n: int) -> Column:
    return ratio(close - sma(close, w, n), stddev(close, w, n))


def bollinger(close: Column, w, n: int, k: float) -> dict[str, Column]:
    middle, spread = sma(close, w, n), stddev(close, w, n) * k
    usable = (spread != 0) & (middle != 0)
    upper, lower = middle + spread, middle - spread
    return {
        "bb_middle": F.when(usable, middle),
        "bb_upper": F.when(usable, upper),
        "bb_lower": F.when(usable, lower),
        "percent_b": ratio(close - lower, F.when(usable, upper - lower)),
        "bandwidth": ratio(F.when(usable, upper - lower), middle),
    }


def roc(close: Column, w, n: int) -> Column:
    past = F.lag(close, n).over(w)
    return ratio(close - past, past) * 100.0


def relative_volume(volume: Column, w, n: int) -> Column:
    return ratio(volume, sma(volume, w, n))


def regression(close: Column, row: Column, w, n: int) -> dict[str, Column]:
    """Least squares on x = 0..n-1; NULL on a flat window, where the fit is undefined."""
    frame = w.rowsBetween(-(n - 1), 0)
    usable = (F.count(close).over(frame) == n) & (F.stddev_pop(close).over(frame) != 0)
    slope = F.covar_pop(close, row).over(frame) / F.lit((n * n - 1) / 12.0)
    explained = slope * F.covar_pop(close, row).over(frame)
    return {
        "reg_slope": F.when(usable, slope),
        "reg_intercept": F.when(usable, F.avg(close).over(frame) - slope * ((n - 1) / 2.0)),
        "reg_r2": F.when(usable, ratio(explained, F.var_pop(close).over(frame))),
    }


def autocorrelation(now: Column, past: Column, w, n: int, lag: int) -> Column:
    """Correlation of a return with the one ``lag`` rows earlier, inside a window of n returns."""
    pairs = w.rowsBetween(-(n - lag - 1), 0)
    spread = F.stddev_pop(now).over(pairs) * F.stddev_pop(past).over(pairs)
    return gated(ratio(F.covar_pop(now, past).over(pairs), spread), now, w.rowsBetween(-(n - 1), 0), n)


def log_return(close: Column, w) -> Column:
    past = F.lag(close, 1).over(w)
    return F.when((close > 0) & (past > 0), F.ln(close) - F.ln(past))


def true_range(high: Column, low: Column, previous_close: Column) -> Column:
    return F.greatest(high - low, F.abs(high - previous_close), F.abs(low - previous_close))


def ema(close: Column, period: int) -> Recursion:
    return Recursion(close, 2.0 / (period + 1))


def wilder(value: Column, period: int, start: int = 1) -> Recursion:
    return Recursion(value, 1.0 / period, start=start, seed_rows=period)


def rsi_from(gain: Column, loss: Column) -> Column:
    value = 100.0 - 100.0 / (1.0 + ratio(gain, loss))
    return F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(value)


def as_doubles(candles: DataFrame) -> DataFrame:
    """Statistics run on doubles; the decimal columns stay at rest."""
    prices = {c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")}
    return candles.filter("is_closed").withColumns(prices)


def feature_series(
    candles: DataFrame, config: FeatureConfig = FeatureConfig(), *, keys: Sequence[str] = KEYS, layout: str = "blocks", recursive: bool | None = True,
    also: Callable[[DataFrame, object], DataFrame] | None = None,
) -> DataFrame:
    """One row per closed candle with all indicator families.

    ``recursive=False`` leaves out EMA, ATR, RSI and EWMA volatility and the join they need; None keeps the columns they
    are made from. ``also`` adds columns over the same frames.
    """
    c = config
    bars = as_doubles(candles)
    placed = positions(bars, keys, ORDER, layout)
    close, volume = F.col("close"), F.col("volume")

    def frames(df: DataFrame, w) -> DataFrame:
        df = df.withColumns({"_prev_close": F.lag(close, 1).over(w), "log_return": log_return(close, w), "_row": F.col("_pos").cast("double")})
        r = F.col("log_return")
        df = df.withColumn("_past_return", F.lag(r, c.autocorrelation_lag).over(w))
        realized = w.rowsBetween(-(c.realized_volatility_period - 1), 0)
        return df.select(
            "*",
            *[col.alias(n) for n, col in returns(close, w, c.return_periods).items()],
            sma(close, w, c.sma_period).alias("sma"),
            stddev(close, w, c.stddev_period).alias("stddev"),
            zscore(close, w, c.zscore_period).alias("zscore"),
            *[col.alias(n) for n, col in bollinger(close, w, c.bollinger_period, c.bollinger_k).items()],
            roc(close, w, c.roc_period).alias("roc"),
            *[col.alias(n) for n, col in regression(close, F.col("_row"), w, c.regression_period).items()],
            autocorrelation(r, F.col("_past_return"), w, c.autocorrelation_period, c.autocorrelation_lag).alias("autocorrelation"),
            gated(F.stddev_pop(r).over(realized), r, realized, c.realized_volatility_period).alias("realized_volatility"),
            relative_volume(volume, w, c.relative_volume_period).alias("relative_volume"),
        )

    rolled = framed(placed, keys, ORDER, frames if also is None else lambda df, w: also(frames(df, w), w), back=c.reach, layout=layout)
    if recursive is None:
        return rolled
    if not recursive:
        return rolled.drop("_prev_close", "_row", "_past_return", "_pos")
    scanned = recursions(rolled, keys, ORDER, _scans(c), layout="plain")
    return scanned.withColumns(
        {"rsi": rsi_from(F.col("_gain"), F.col("_loss")), "ewma_volatility": F.sqrt("_variance")}
    ).drop("_prev_close", "_row", "_past_return", "_gain", "_loss", "_variance", "_pos")


def _scans(c: FeatureConfig) -> dict[str, Recursion]:
    """The recursive indicators, over ``_prev_close`` and ``log_return`` of the frames."""
    close, change = F.col("close"), F.col("close") - F.col("_prev_close")
    return {
        "ema": ema(close, c.ema_period),
        "atr": wilder(true_range(F.col("high"), F.col("low"), F.col("_prev_close")), c.atr_period),
        "_gain": wilder(F.greatest(change, F.lit(0.0)), c.rsi_period, start=2),
        "_loss": wilder(F.greatest(-change, F.lit(0.0)), c.rsi_period, start=2),
        "_variance": Recursion(F.col("log_return") * F.col("log_return"), 1.0 - c.ewma_lambda, start=2),
    }


# --- one batch after the other --------------------------------------------------------------------
BAR = ("instrument", "timeframe", "open_time", "close_time", "open", "high", "low", "close", "volume")
#: Values of the recursions after a bar, and the latest bandwidth known: with the bars a frame reaches back to, all that
#: the next batch needs of those before it.
CARRIED = ("ema", "atr", "_gain", "_loss", "_variance", "fast_ema", "slow_ema", "_known")
STATE_DDL = "instrument string, timeframe string, open_time timestamp, close_time timestamp, open double, high double, low double, close double, volume double, n long, " + ", ".join(f"s_{c} double" for c in CARRIED)
#: The spans of the two averages whose crossing is a signal, and the bars of a look-back return.
CROSSOVER = (12, 26)
LOOKBACK = 10
STREAMED = (
    "ret_1", "ret_5", "ret_15", "ret_60", "sma", "stddev", "zscore", "bb_middle", "bb_upper", "bb_lower", "percent_b", "bandwidth", "roc", "reg_slope", "reg_intercept", "reg_r2",
    "autocorrelation", "realized_volatility", "relative_volume", "ema", "atr", "rsi", "ewma_volatility", "fast_ema", "slow_ema", "prev_diff", "diff", "lookback_return", "prev_bandwidth",
    "last_bandwidth",
)


def kept_bars(config: FeatureConfig) -> int:
    """Bars of a series that stay in its state: those the longest frame of the next bar reaches."""
    return max(config.reach, CROSSOVER[1], LOOKBACK) + 2


def continued(bars: DataFrame, state: DataFrame, config: FeatureConfig = FeatureConfig(), *, layout: str = "blocks") -> tuple[DataFrame, DataFrame]:
    """(features of new bars, state after them): the block operators over a batch and each series' state before it.

    ``bars`` (columns ``BAR``) are later than those of the state (``STATE_DDL``: the last ``kept_bars`` of each series
    with their number ``n`` and the recursions' values). A recursion goes on from its value as one more summand that
    decays, so nothing before the state is read again and blocks of one busy series run apart, as in
    ``feature_series``. While a state holds its whole series, seeds included, the series is computed from its start.
    """
    kept = kept_bars(config)
    ends = state.groupBy(*KEYS).agg(F.max("n").alias("_last"), F.count(F.lit(1)).alias("_held"))
    fresh = bars.select(*BAR, F.lit(None).cast("long").alias("n"), *[F.lit(None).cast("double").alias(f"s_{c}") for c in CARRIED], F.lit(False).alias("_old"))
    rows = same_key_join(state.withColumn("_old", F.lit(True)).select(fresh.columns).unionByName(fresh), ends, KEYS, "left")
    placed = positions(rows, KEYS, ORDER, "blocks" if layout == "blocks" else layout)
    beyond = F.coalesce(F.col("_last") > kept, F.lit(False))
    placed = placed.withColumns({"n": F.coalesce(F.col("_last") - F.col("_held"), F.lit(0)) + F.col(POS), "_skip": F.col("_old") & beyond})
    placed = placed.withColumn("_turn", F.col("_skip") & (F.col("n") == F.col("_last")))

    def signals(df: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-(LOOKBACK - 1), 0)
        change = gated(ratio(F.col("close"), F.first("close").over(frame)) - 1.0, F.col("close"), frame, LOOKBACK)
        return df.withColumns({"lookback_return": change, "last_bandwidth": F.lag("bandwidth", 1).over(w)})

    # The recursions and the running values each read their rows twice, so frames are kept, not computed again.
    rolled = stable(feature_series(placed.withColumn("is_closed", F.lit(True)), config, layout=layout, recursive=None, also=signals))
    scans = {**_scans(config), "fast_ema": ema(F.col("close"), CROSSOVER[0]), "slow_ema": ema(F.col("close"), CROSSOVER[1])}
    scans = {n: replace(s, carry=F.when(F.col("_turn"), F.col(f"s_{n}")), skip=F.col("_skip")) for n, s in scans.items()}
    scanned = recursions(rolled, KEYS, ORDER, scans, layout="plain").withColumn("diff", F.col("fast_ema") - F.col("slow_ema"))
    scanned = stable(scanned)
    own = F.when(F.col("_turn"), F.col("s__known")).when(~F.col("_skip"), F.col("bandwidth"))
    known = running(scanned.withColumn("_own", own), KEYS, ORDER, {"prev_bandwidth": ("last", F.col("_own")), "prev_diff": ("last", F.col("diff"))}, inclusive=False, layout=layout)
    done = stable(known.withColumns({"_known": F.coalesce("_own", "prev_bandwidth"), "rsi": rsi_from(F.col("_gain"), F.col("_loss")), "ewma_volatility": F.sqrt("_variance")}))
    newest = done.groupBy(*KEYS).agg(F.max("n").alias("_newest"))
    last = same_key_join(done, newest, KEYS).filter(F.col("n") > F.col("_newest") - kept)
    return done.filter(~F.col("_old")).select(*BAR, *STREAMED), last.select(*BAR, "n", *[F.col(c).alias(f"s_{c}") for c in CARRIED])


def previous_known(features: DataFrame, column: str, *, keys: Sequence[str] = KEYS, layout: str = "blocks") -> DataFrame:
    """Append the latest earlier non-NULL value of a column."""
    return running(features, keys, ORDER, {f"prev_{column}": ("last", F.col(column))}, inclusive=False, layout=layout)


Family = Callable[[DataFrame, object], DataFrame]


def indicator(
    candles: DataFrame, build: Family, *, reach: int, keys: Sequence[str] = KEYS, layout: str = "blocks"
) -> DataFrame:
    """A user-chosen subset of frame indicators: ``build(df, window)`` over closed candles."""
    return framed(as_doubles(candles), keys, ORDER, build, back=reach, layout=layout)
