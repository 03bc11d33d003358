"""Candle-table operators: resampling, merging, validation and window slicing.

A candle row has ``instrument, timeframe, open_time, close_time, open, high, low, close, volume,
is_closed``; times are timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.series import as_of, placed_once, running
from tickloom.schemas import timeframe_seconds
from tickloom.session import stable

KEYS = ("instrument", "timeframe")

# Frames derived from one-minute bars, and the look-back windows in months.
DERIVED_TIMEFRAMES = ("5m", "15m", "1h")
RECENT_WINDOWS = {"full": None, "24m": 24, "12m": 12, "6m": 6, "3m": 3}


def bucket_start(ts: Column, seconds: int) -> Column:
    """Epoch-aligned bucket start (seven-day buckets start on Thursday)."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)) * seconds)


def candles_from_trades(
    trades: DataFrame, timeframe: str, *, keys: Sequence[str] = ("instrument",), ts: str = "ts", tie: str = "trade_id"
) -> DataFrame:
    """Bars from a trade tape; partial aggregation happens before the shuffle."""
    seconds = timeframe_seconds(timeframe)
    at = F.struct(F.col(ts), F.col(tie))
    return (
        trades.groupBy(*keys, bucket_start(F.col(ts), seconds).alias("open_time"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("quantity").cast("decimal(38,8)").alias("volume"),
        )
        .withColumn("timeframe", F.lit(timeframe))
        .withColumn("close_time", F.col("open_time") + F.make_dt_interval(secs=F.lit(seconds)))
        .withColumn("is_closed", F.lit(True))
    )


def closed_only(candles: DataFrame) -> DataFrame:
    return candles.filter("is_closed")


def resample(candles: DataFrame, source: str, target: str, *, keys: Sequence[str] = ("instrument",)) -> DataFrame:
    """Coarser bars; a bucket appears only if every source bar is there. Deduplicate first."""
    step, width = timeframe_seconds(source), timeframe_seconds(target)
    if width % step:
        raise ValueError("the target timeframe must be a multiple of the source")
    at = F.col("open_time")
    return (
        candles.groupBy(*keys, bucket_start(at, width).alias("_bucket"))
        .agg(
            F.min_by("open", at).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", at).alias("close"),
            F.sum("volume").cast("decimal(38,8)").alias("volume"),
            F.count(F.lit(1)).alias("_bars"),
        )
        .filter(F.col("_bars") == width // step)
        .withColumnRenamed("_bucket", "open_time")
        .withColumn("close_time", F.col("open_time") + F.make_dt_interval(secs=F.lit(width)))
        .withColumn("timeframe", F.lit(target))
        .withColumn("is_closed", F.lit(True))
        .drop("_bars")
    )


def derive_timeframes(candles: DataFrame, source: str = "1m", targets: Sequence[str] = DERIVED_TIMEFRAMES) -> DataFrame:
    """All derived frames from one source, each source bar read once.

    The bucket list is exploded, so one shuffle serves every target.
    """
    step = timeframe_seconds(source)
    widths = {t: timeframe_seconds(t) for t in targets}
    options = F.array(*[F.struct(F.lit(t).alias("timeframe"), F.lit(w).cast("long").alias("width")) for t, w in widths.items()])
    at = F.col("open_time")
    spread = candles.drop("timeframe").withColumn("_t", F.explode(options)).select("*", "_t.timeframe", "_t.width")
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds(at) / F.col("width")) * F.col("width"))
    return (
        spread.groupBy("instrument", "timeframe", "width", bucket.alias("_bucket"))
        .agg(
            F.min_by("open", at).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", at).alias("close"),
            F.sum("volume").cast("decimal(38,8)").alias("volume"),
            F.count(F.lit(1)).alias("_bars"),
        )
        .filter(F.col("_bars") * step == F.col("width"))
        .withColumn("close_time", F.timestamp_seconds(F.unix_seconds("_bucket") + F.col("width")))
        .withColumnRenamed("_bucket", "open_time")
        .withColumn("is_closed", F.lit(True))
        .drop("_bars", "width")
    )


def high_water_mark(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Where an incremental load resumes for each key."""
    return candles.groupBy(*keys).agg(F.max("close_time").alias("resume_at"))


def fetch_since(incoming: DataFrame, marks: DataFrame, start: str = "2017-01-01", keys: Sequence[str] = KEYS) -> DataFrame:
    """Incoming rows at or after the key's high-water mark (or the history start)."""
    return (
        incoming.join(marks, list(keys), "left")
        .filter(F.col("open_time") >= F.coalesce(F.col("resume_at"), F.lit(start).cast("timestamp")))
        .drop("resume_at")
    )


def merge_incremental(existing: DataFrame, fetched: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Union with duplicate open times resolved in favour of the existing row.

    Built on a partial aggregate, so many copies of one bar shrink before the shuffle.
    """
    columns = existing.columns
    rest = [c for c in columns if c not in (*keys, "open_time")]
    tagged = existing.withColumn("_new", F.lit(False)).unionByName(fetched.select(*columns).withColumn("_new", F.lit(True)))
    row = F.struct(*[F.col(c) for c in rest])
    rank = F.struct(F.col("_new"), *[F.col(c) for c in rest])
    return (
        tagged.groupBy(*keys, "open_time")
        .agg(F.min_by(row, rank).alias("_row"), F.min("_new").alias("is_new"))
        .select(*keys, "open_time", "_row.*", "is_new")
    )


def update_summary(merged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts before / after / new and the covered range, from ``merge_incremental`` output."""
    return merged.groupBy(*keys).agg(
        F.count_if(~F.col("is_new")).alias("candles_before"),
        F.count(F.lit(1)).alias("candles_after"),
        F.count_if(F.col("is_new")).alias("candles_new"),
        F.min("open_time").alias("earliest"),
        F.max("close_time").alias("latest"),
    )


def audit(candles: DataFrame, timeframe: str, *, seq: str = "seq", keys: Sequence[str] = KEYS, layout: str = "blocks") -> DataFrame:
    """Mark each row with the checks below, in arrival order ``seq`` (unique per key).

    ``is_duplicate``: open time already seen. ``is_out_of_order``: not later than the latest accepted
    row. ``missing``: whole bars absent before an accepted row. The latest accepted row is the
    running maximum of open time, so one running aggregate serves all three.
    """
    step_us = timeframe_seconds(timeframe) * 1_000_000
    first = candles.groupBy(*keys, "open_time").agg(F.min(seq).alias("_first_seq"))
    marked = candles.join(first, [*keys, "open_time"]).withColumn("is_duplicate", F.col(seq) > F.col("_first_seq"))
    latest = F.when(~F.col("is_duplicate"), F.struct("open_time", "close_time"))
    seen = running(marked, keys, [seq], {"_prev": ("max", latest)}, inclusive=False, layout=layout)
    late = ~F.col("is_duplicate") & F.coalesce(F.col("open_time") <= F.col("_prev.open_time"), F.lit(False))
    gap = F.unix_micros("open_time") - F.unix_micros("_prev.close_time")
    whole = F.floor(gap / F.lit(step_us))
    return (
        seen.withColumn("is_out_of_order", late)
        .withColumn("previous_close", F.col("_prev.close_time"))
        .withColumn(
            "missing",
            F.when(~F.col("is_duplicate") & ~F.col("is_out_of_order") & (gap > 0) & (whole > 0), whole).otherwise(F.lit(0)).cast("long"),
        )
        .drop("_first_seq", "_prev")
    )


def duplicates(audited: DataFrame) -> DataFrame:
    return audited.filter("is_duplicate")


def out_of_order(audited: DataFrame) -> DataFrame:
    return audited.filter("is_out_of_order")


def gaps(audited: DataFrame) -> DataFrame:
    return audited.filter("missing > 0")


def validation_report(audited: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    report = audited.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("missing") > 0).alias("gap_count"),
        F.sum("missing").alias("total_missing"),
        F.count_if(F.col("is_duplicate")).alias("duplicate_count"),
        F.count_if(F.col("is_out_of_order")).alias("out_of_order_count"),
    )
    return report.withColumn("is_clean", (F.col("gap_count") + F.col("duplicate_count") + F.col("out_of_order_count")) == 0)


def strict_gate(table: DataFrame, report: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(rows of clean keys, list of skipped keys with their counts)."""
    bad = report.filter(~F.col("is_clean"))
    return table.join(bad.select(*keys), list(keys), "left_anti"), bad


def recent_windows(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of each look-back window, tagged with ``window``; one pass for all windows.

    Month arithmetic clamps the day and keeps the time of day.
    """
    ends = candles.groupBy(*keys).agg(F.max("close_time").alias("_end"))
    spans = F.array(
        *[F.struct(F.lit(w).alias("window"), F.lit(m).cast("int").alias("months")) for w, m in RECENT_WINDOWS.items()]
    )
    tagged = candles.join(ends, list(keys)).withColumn("_w", F.explode(spans)).select("*", "_w.window", "_w.months")
    since = F.col("_end") - F.make_ym_interval(F.lit(0), F.col("months"))
    return tagged.filter(F.col("months").isNull() | (F.col("open_time") >= since)).drop("_end", "_w", "months")


def buy_and_hold(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    first = F.min_by("close", "open_time").cast("double")
    last = F.max_by("close", "open_time").cast("double")
    return candles.groupBy(*keys).agg(((last - first) / F.nullif(first, F.lit(0.0))).alias("benchmark_return"))


def mark_prices(candles: DataFrame, keys: Sequence[str] = ("instrument",)) -> DataFrame:
    return candles.groupBy(*keys).agg(
        F.max_by("close", "close_time").alias("price"), F.max("close_time").alias("updated_at")
    )


# --- exact de-duplication with bounded memory -----------------------------------------------------
SEEN_DDL = "instrument string, timeframe string, step long, phase long, start timestamp, end timestamp"
GRID = ("instrument", "timeframe", "step", "phase")


def _on_grid(bars: DataFrame) -> DataFrame:
    """Bars with the length of their grid in whole seconds and their place on it."""
    length = F.unix_micros("close_time") - F.unix_micros("open_time")
    step = F.greatest(F.ceil(length / 1_000_000) * 1_000_000, F.lit(1_000_000)).cast("long")
    return bars.withColumn("step", step).withColumn("phase", F.pmod(F.unix_micros("open_time"), F.col("step")))


def unseen(bars: DataFrame, seen: DataFrame, *, layout: str = "blocks") -> tuple[DataFrame, DataFrame]:
    """(bars that ``seen`` does not hold, each once; ``seen`` with them): exact, however late a bar is.

    ``seen`` (``SEEN_DDL``) holds runs of consecutive bars, so a series without gaps is one row for ever, and each gap
    adds one until it is filled. Bars beside the grid of a series are runs of a grid of their own. A bar is looked up
    by an as-of merge; runs that meet grow together. Of copies of a bar the smallest row stays.
    """
    rest = [c for c in bars.columns if c not in ("instrument", "timeframe", "open_time")]
    once = bars.groupBy("instrument", "timeframe", "open_time").agg(F.min(F.struct(*rest)).alias("_b")).select("instrument", "timeframe", "open_time", "_b.*")
    found = as_of(_on_grid(once), seen.select(*GRID, "start", F.col("end").alias("_end")), GRID, "open_time", "start", ["_end"], layout=layout)
    new = stable(found.filter("_end IS NULL OR open_time > _end"))
    runs = seen.select(*GRID, "start", "end").unionByName(new.select(*GRID, F.col("open_time").alias("start"), F.col("open_time").alias("end")))
    placed = placed_once(runs, GRID, ["start"], layout)
    before = running(placed, GRID, ["start"], {"_until": ("max", F.col("end"))}, inclusive=False, layout=layout)
    apart = F.coalesce(F.unix_micros("start") > F.unix_micros("_until") + F.col("step"), F.lit(True))
    numbered = running(before.withColumn("_apart", F.when(apart, 1)), GRID, ["start"], {"_run": ("count", F.col("_apart"))}, layout=layout)
    return new.select(bars.columns), numbered.groupBy(*GRID, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
