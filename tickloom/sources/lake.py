"""Candle lake, tick lake and report files. Every scan has a declared schema."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from tickloom import schemas as S
from tickloom.schemas import TICK_KINDS
from tickloom.sources import commits
from tickloom.sources.messages import fits_scale

#: Kinds of rows in a lake: ticks, what the ingest knows of them, and published bars.
KINDS = {**TICK_KINDS, "desync": S.DESYNC_ROWS, "continuity": S.CONTINUITY, "bars": S.PUBLISHED_BARS}
FILES_PER_DAY = 4
FILE_BYTES = 512 * 1024 * 1024
# The order rows of a kind are read in.
DAY_ORDER = {
    "trades": ("timestamp_ms", "exchange_trade_id"),
    "book_ticker": ("update_id",),
    "book_deltas": ("final_update_id",),
    "book_snapshots": ("last_update_id", "is_bid", "level_index"),
}


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def scan(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table, or no rows where nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names right below a folder; none if it is not there."""
    if not exists(spark, path):
        return []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)]


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def exact(df: DataFrame, column: str) -> Column:
    """The column at rest scale; a value of more than eight decimals is refused, not rounded."""
    kind = df.schema[column].dataType
    if not isinstance(kind, DecimalType) or kind.scale <= 8:
        return F.col(column).cast(S.AT_REST).alias(column)
    refused = F.raise_error(F.concat(F.lit(f"more than eight decimals in {column}: "), F.col(column).cast("string"))).cast(S.AT_REST)
    return F.when(F.col(column).isNull() | fits_scale(F.col(column)), F.col(column).cast(S.AT_REST)).otherwise(refused).alias(column)


# --- candles ----------------------------------------------------------------------------------
def write_candles(candles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy Parquet by symbol and timeframe; times as epoch milliseconds, prices at rest scale."""
    rows = candles.select(
        F.unix_millis("open_time").alias("open_time"), F.unix_millis("close_time").alias("close_time"),
        *[exact(candles, c) for c in ("open", "high", "low", "close", "volume")], F.col("instrument").alias("symbol"), "timeframe",
    )
    # No exchange: a series may be spread over files, and one hot symbol must not end in one task.
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "timeframe").parquet(path)


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Stored candles are closed ones; filters on symbol and timeframe prune folders."""
    rows = scan(spark, path, S.CANDLES)
    return rows.select(
        F.col("symbol").alias("instrument"), "timeframe", F.timestamp_millis("open_time").alias("open_time"), F.timestamp_millis("close_time").alias("close_time"),
        *[F.col(c).cast(S.MONEY).alias(c) for c in ("open", "high", "low", "close")], "volume", F.lit(True).alias("is_closed"),
    )


# --- ticks ------------------------------------------------------------------------------------
def tick_rows(kind: str, rows: DataFrame) -> DataFrame:
    """Rows of a kind in stored form, dated by their event time."""
    schema = KINDS[kind]
    clock = next(f.name for f in schema.fields if f.name.endswith("_ms"))
    dated = rows.withColumn("date", F.to_date(F.timestamp_millis(clock)))
    return dated.select(*[exact(dated, f.name) if f.dataType == S.AT_REST else F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _write_batch(rows: DataFrame, path: str, kind: str, batch: str) -> list[dict]:
    """Rows of a kind in stored form as the folders of a new batch, not yet part of the table."""
    rows.write.partitionBy("symbol", "date").parquet(f"{path}/{kind}/batch={batch}")
    return commits.written(rows.sparkSession, path, kind, batch)


def write_dealt(kind: str, rows: DataFrame, path: str, batch: str) -> list[dict]:
    """``_write_batch`` of rows dealt by symbol, day and a bounded salt: a few files a day, and no task with a whole hot symbol."""
    salt = F.pmod(F.xxhash64(*KINDS[kind].names), F.lit(FILES_PER_DAY))
    return _write_batch(tick_rows(kind, rows).repartition("symbol", "date", salt), path, kind, batch)


def append_all(tables: Mapping[str, DataFrame], path: str, batch: str | None = None, replace: Sequence[str] = ()) -> int | None:
    """Add rows of several kinds in one commit; its version, or None if the batch is in the table already.

    ``batch``, ``<stream>-<number>``, names a batch of a stream, whose numbers rise: one that comes again, as after a
    crash, adds nothing, also if its rows were compacted meanwhile. Rows are dealt by symbol, day and a bounded salt
    first: a few files a day, and no task with a whole hot symbol. Of kinds in ``replace`` the rows before go.
    """
    spark = next(iter(tables.values())).sparkSession
    app, number = batch.rsplit("-", 1) if batch else (None, None)
    if app is not None and commits.applied(spark, path, app) >= int(number):
        return None
    name = f"w-{uuid.uuid4().hex}"

    def write(kind: str) -> list[dict]:
        return write_dealt(kind, tables[kind], path, name)

    # The kinds are jobs of their own; side by side they fill the cluster better than one after the other.
    with ThreadPoolExecutor(len(tables)) as pool:
        adds = [a for own in pool.map(inheritable_thread_target(spark)(write), tables) for a in own]
    removes = [r.asDict() for r in commits.folders(spark, path).filter(F.col("kind").isin(list(replace))).collect()] if replace else []
    return commits.commit(spark, path, adds, removes, app, None if number is None else int(number))


def append_ticks(kind: str, rows: DataFrame, path: str, batch: str | None = None) -> int | None:
    """``append_all`` of one kind."""
    return append_all({kind: rows}, path, batch)


def read_ticks(spark: SparkSession, path: str, kind: str, symbol: str | None = None, date: str | None = None, *, version: int | None = None) -> DataFrame:
    """The rows that the newest commit (or ``version``) says; symbol and date choose folders in the log, before anything is listed.

    No order is imposed, downstream operators sort by what they need.
    """
    live = commits.folders(spark, path, version).filter(F.col("kind") == kind)
    live = live if symbol is None else live.filter(F.col("symbol") == symbol)
    live = live if date is None else live.filter(F.col("date") == str(date))
    # As many names as the reader's own list of folders has.
    return read_folders(spark, path, kind, live.select("folder").collect())


def in_day_order(kind: str, rows: DataFrame) -> DataFrame:
    """Rows of a day in the order a replay reads them (bids before asks)."""
    return rows.orderBy(*[F.col(c).desc() if c == "is_bid" else F.col(c) for c in DAY_ORDER[kind]])


def compact_day(spark: SparkSession, path: str, symbol: str, date: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rewrite one symbol's day into as few files as its size allows; one row per kind.

    The new files are written beside the old ones and one commit changes between them, for all kinds at once: readers
    see the day before or after it, a job that is lost leaves the day as it was, and what others append meanwhile stays.
    If another job has compacted the day meanwhile, its commit holds and this one says ``rewritten`` false. A day that
    is compact already is left alone. Old files go in ``commits.vacuum``.
    """
    day = commits.folders(spark, path).filter((F.col("symbol") == symbol) & (F.col("date") == str(date))).collect()  # the batches of one symbol's day
    summary, adds, removes = [], [], []
    batch = f"c-{uuid.uuid4().hex}"
    for kind in TICK_KINDS:
        own = [r for r in day if r.kind == kind]
        before = sum(r.files for r in own)
        wanted = max(1, -(-sum(commits.size(spark, path, r.folder) for r in own) // file_bytes)) if before > 1 else 1
        rows = read_folders(spark, path, kind, own)
        if before <= wanted:
            summary.append((kind, before, before, rows.count(), False))
            continue
        order = [F.col(c).desc() if c == "is_bid" else F.col(c) for c in DAY_ORDER[kind]]
        spread = rows.coalesce(1) if wanted == 1 else rows.repartitionByRange(wanted, *order)
        adds += _write_batch(spread.sortWithinPartitions(*order), path, kind, batch)
        removes += [r.asDict() for r in own]
        new = [Row(**a) for a in adds if a["kind"] == kind]
        count, kept = rows.count(), read_folders(spark, path, kind, new).count()
        if kept != count:
            raise OSError(f"{kind} of {symbol}, {date}: {kept} of {count} rows written")
        summary.append((kind, before, sum(r.files for r in new), count, True))
    if removes:
        try:
            commits.commit(spark, path, adds, removes)
        except commits.Conflict:
            summary = [(kind, before, before, count, False) for kind, before, _, count, _ in summary]
    return spark.createDataFrame(summary, "kind string, files_before long, files_after long, rows long, rewritten boolean")


def read_folders(spark: SparkSession, path: str, kind: str, own: Sequence[Row]) -> DataFrame:
    """The rows of these folders of a kind."""
    if not own:
        return spark.createDataFrame([], KINDS[kind])
    return spark.read.schema(KINDS[kind]).option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{r.folder}" for r in own]).select(*KINDS[kind].names)


def write_grid(grid: DataFrame, path: str) -> None:
    dated = grid.withColumn("date", F.to_date(F.timestamp_millis("timestamp_ms")))
    dated.select(*S.FEATURE_GRID.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "date").parquet(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, S.FEATURE_GRID)


# --- logs, reports, tables --------------------------------------------------------------------
def append_desync(rows: DataFrame, path: str) -> None:
    rows.select(*S.DESYNC_LOG.names).write.mode("append").json(path)


def read_desync(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.DESYNC_LOG).json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON folder per run key."""
    reports.write.mode("overwrite").partitionBy("symbol", "timeframe", "strategy_id", "window").json(path)


def read_reports(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All reports below a folder except the diagnosis that may lie among them."""
    return spark.read.schema(schema).json(path).filter(~F.col("_metadata.file_name").startswith("diagnostic"))


# Columns of the summary file.
SUMMARY_COLUMNS = (
    "symbol", "timeframe", "window", "strategy_id", "candles_used", "gap_count", "missing_candles_total", "duplicate_candles", "out_of_order_candles", "total_trades", "winners",
    "losers", "win_rate", "profit_factor", "net_return_pct", "gross_return_pct", "average_daily_return_pct", "positive_days", "negative_days", "max_drawdown_pct",
    "max_drawdown_abs", "average_win", "average_loss", "average_trade_duration_seconds", "total_fees", "total_spread_cost", "total_slippage_cost", "benchmark_return_pct",
)
REPORT_NAMES = {
    "missing_candles_total": "total_missing", "duplicate_candles": "duplicate_count", "out_of_order_candles": "out_of_order_count", "max_drawdown_abs": "max_drawdown",
    "average_trade_duration_seconds": "average_duration_s", "benchmark_return_pct": "benchmark_return",
}


def summary_table(reports: DataFrame) -> DataFrame:
    return reports.select(*[F.col(REPORT_NAMES.get(c, c)).alias(c) for c in SUMMARY_COLUMNS])


# A CSV file with line breaks in its fields is read by one task.
CSV_ROWS = 200_000


def write_csv(df: DataFrame, path: str, missing: str = "") -> None:
    """``missing`` stands for nulls (a summary has ``-``). A file has at most ``CSV_ROWS`` rows, whatever a task holds."""
    df.write.mode("overwrite").option("maxRecordsPerFile", CSV_ROWS).csv(path, header=True, quote='"', escape='"', nullValue=missing)


def read_csv(spark: SparkSession, path: str, schema: StructType, missing: str = "") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', nullValue=missing)


def write_json(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Validation records, signal reports and other one-row-per-key results."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def append_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Signals, orders, fills, trades, snapshots, decisions, evaluations and switches only ever grow."""
    df.write.mode("append").partitionBy(*by).parquet(path)
