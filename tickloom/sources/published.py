"""Published bars that late trades repair.

A bar is stored in a form that merges: its first and last trade, extremes and sums. Trades of a batch become such parts,
the days they touch are merged with what is there and take its place in one commit (``commits``), so readers see the
bars before or after a batch, and no trade is too late, however old its bar. A replayed batch changes nothing. What a
batch reads and writes are the days it touches, not the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas as S
from tickloom.operators.candles import bucket_start, timeframe_seconds
from tickloom.sources import commits, lake

KIND = "bars"
KEY = ("symbol", "timeframe", "open_ms")
#: How a null symbol is called in the names of folders.
NO_SYMBOL = "__HIVE_DEFAULT_PARTITION__"


def bar_parts(trades: DataFrame, timeframe: str, batch: int) -> DataFrame:
    """What these trades (instrument, ts, trade_id, price, quantity) say about their bars; partial sums go before the shuffle.

    Trades without a time belong to no bar and are left out (``reports.conform`` counts them).
    """
    at = F.struct(F.unix_micros("ts").alias("us"), F.col("trade_id").cast("long").alias("id"))
    seconds = timeframe_seconds(timeframe)
    label = next(name for name, n in S.TIMEFRAME_SECONDS.items() if n == seconds)
    start = F.unix_millis(bucket_start(F.col("ts"), seconds))
    # Trades of one time and number have the price for their order.
    first, last = F.min(F.struct(at.alias("at"), "price")).alias("_first"), F.max(F.struct(at.alias("at"), "price")).alias("_last")
    return (
        trades.filter("ts IS NOT NULL").groupBy(F.col("instrument").alias("symbol"), F.lit(label).alias("timeframe"), start.alias("open_ms"))
        .agg(first, last, F.max("price").alias("high"), F.min("price").alias("low"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trades"))
        .select(*KEY, F.col("_first.at.us").alias("first_us"), F.col("_first.at.id").alias("first_id"), F.col("_first.price").alias("open"), "high", "low",
                F.col("_last.at.us").alias("last_us"), F.col("_last.at.id").alias("last_id"), F.col("_last.price").alias("close"), "volume", "trades",
                F.lit(batch).cast("long").alias("since"), F.lit(batch).cast("long").alias("revision"))
    )


def merged(parts: DataFrame) -> DataFrame:
    """One bar of all its parts, in whatever order they came."""
    first, last = F.struct("first_us", "first_id", "open"), F.struct("last_us", "last_id", "close")
    return (
        parts.groupBy(*KEY)
        .agg(F.min(first).alias("_first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(last).alias("_last"), F.sum("volume").cast(S.AT_REST).alias("volume"),
             F.sum("trades").alias("trades"), F.min("since").alias("since"), F.max("revision").alias("revision"))
        .select(*KEY, "_first.*", "high", "low", "_last.*", "volume", "trades", "since", "revision")
    )


def publish(trades: DataFrame, path: str, timeframe: str, batch: int, app: str = "bars") -> int | None:
    """Merge the trades of one batch of the stream ``app`` into the bars; the commit's version, or None if it was there."""
    spark = trades.sparkSession
    if commits.applied(spark, path, app) >= batch:
        return None
    parts = lake.tick_rows(KIND, bar_parts(trades, timeframe, batch))
    parts.persist()
    days = parts.select(F.coalesce("symbol", F.lit(NO_SYMBOL)).alias("symbol"), F.col("date").cast("string").alias("date")).distinct()
    # Folders of the days that this batch touches, as many names as the reader's own list has.
    before = commits.folders(spark, path).filter(F.col("kind") == KIND).join(days, ["symbol", "date"], "left_semi").select(*commits.FOLDER).collect()
    rows = merged(lake.read_folders(spark, path, KIND, before).unionByName(parts))
    adds = lake.write_dealt(KIND, rows, path, f"p-{uuid.uuid4().hex}")
    version = commits.commit(spark, path, adds, [r.asDict() for r in before], app, batch)
    parts.unpersist()
    return version


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, date: str | None = None, *, version: int | None = None) -> DataFrame:
    """The bars of the newest commit (or ``version``); ``repaired`` says that a later batch changed a bar, ``revision`` which."""
    rows = lake.read_ticks(spark, path, KIND, symbol, date, version=version)
    start = F.timestamp_millis("open_ms")
    # The length of a bar stands in its timeframe.
    seconds = F.coalesce(*[F.when(F.col("timeframe") == name, F.lit(n)) for name, n in S.TIMEFRAME_SECONDS.items()])
    return rows.select(
        F.col("symbol").alias("instrument"), "timeframe", start.alias("open_time"), F.timestamp_millis(F.col("open_ms") + seconds * 1000).alias("close_time"),
        *[F.col(c).cast(S.MONEY).alias(c) for c in ("open", "high", "low", "close")], "volume", "trades", (F.col("revision") > F.col("since")).alias("repaired"), "revision")
