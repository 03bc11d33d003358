"""Structured Streaming twins of the batch operators.

Nothing is dropped for being late unless the caller gives a delay; ``late_sink`` keeps and counts late rows. Keyed state lives in the state
store; sinks are ``foreachBatch`` writers that overwrite their own batch, so a batch that runs again
leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom import schemas as S
from tickloom.operators import books
from tickloom.operators import candles as C
from tickloom.operators import features as X
from tickloom.operators import signals as G
from tickloom.operators.books import DEPTH, WINDOW_SECONDS
from tickloom.operators.joins import crowded_join, latest_per
from tickloom.operators.series import same_key_join
from tickloom.session import stable
from tickloom.sources import commits, lake, messages, published

TICK_WATERMARK = "5 seconds"
# Fixed value: candles fed before going live.
WARMUP_BARS = 50


# --- sources ----------------------------------------------------------------------------------
def raw_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed raw messages as a stream."""
    reader = spark.readStream.schema(S.RAW_MESSAGES)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def candle_stream(raw: DataFrame) -> DataFrame:
    """Kline messages of every timeframe as one candle feed."""
    k = messages.route(raw)["klines"]
    return k.withColumnRenamed("symbol", "instrument").withColumns({c: F.col(c).cast(S.AT_REST) for c in messages.PRICES})


BAR_KEY = ["instrument", "timeframe", "open_time"]


def closed_once(candles: DataFrame, delay: str | None = None) -> DataFrame:
    """Closed candles only, each bar once even if a reconnect repeats it.

    Bars are remembered for good, so none is too late, however far apart instruments are; ``closed_once_sink`` remembers
    them as runs. With ``delay`` the memory is bounded by it; feed such a stream through ``late_sink`` first, which keeps
    and counts what comes later.
    """
    closed = candles.filter("is_closed")
    return closed.dropDuplicates(BAR_KEY) if delay is None else closed.withWatermark("close_time", delay).dropDuplicatesWithinWatermark(BAR_KEY)


def closed_once_sink(path: str, layout: str = "blocks") -> Callable[[DataFrame, int], None]:
    """Closed candles, each bar once at any lateness, to ``rows``; what was seen is kept as runs of bars (``candles.unseen``).

    Unlike the state of ``closed_once``, a row a bar for ever, a series without gaps takes one row. A batch that runs
    again starts from the runs before it and writes the same.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, f"{path}/seen") if v < batch_id]
        seen = spark.read.schema(C.SEEN_DDL).parquet(f"{path}/seen/v={before[-1]}") if before else spark.createDataFrame([], C.SEEN_DDL)
        new, after = C.unseen(batch.filter("is_closed"), seen, layout=layout)
        new.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{path}/seen/v={batch_id}")
        for old in before[:-1]:
            lake.remove(spark, f"{path}/seen/v={old}")

    return write


def candle_union(feeds: list[DataFrame]) -> DataFrame:
    """The feeds of several timeframes as one stream."""
    return reduce(DataFrame.unionByName, feeds)


def late_sink(path: str, clock: str, seconds: float) -> Callable[[DataFrame, int], None]:
    """Rows of a batch to ``rows``; those more than ``seconds`` older than the newest of the batches before to ``late``.

    Nothing is dropped: ``late`` is a table to count and to merge from. The marks of earlier batches are kept, so a
    batch that runs again parts its rows alike.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        known = lake.scan(spark, f"{path}/mark", T.StructType([T.StructField("newest", T.TimestampType()), T.StructField("batch", T.LongType())]))
        mark = known.filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        newest = batch.agg(F.max(clock)).first()[0]
        late = F.lit(False) if mark is None else F.coalesce(F.col(clock) < F.lit(mark - timedelta(seconds=seconds)), F.lit(False))
        batch.filter(~late).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        seen = [x for x in (mark, newest) if x is not None]
        spark.createDataFrame([(max(seen) if seen else None,)], "newest timestamp").write.mode("overwrite").parquet(f"{path}/mark/batch={batch_id}")
        batch.unpersist()

    return write


def bars_sink(path: str, timeframe: str, app: str = "bars") -> Callable[[DataFrame, int], None]:
    """Trades of a batch into published bars, each batch one commit; late trades repair the bars they belong to.

    What ``tumbling_candles`` leaves out is in these bars, at any lateness. Trades that come twice count twice: their
    stream is de-duplicated before. Readers take ``published.read_bars``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        published.publish(batch, path, timeframe, batch_id, app)

    return write


def tumbling_candles(trades: DataFrame, seconds: int, delay: str = TICK_WATERMARK) -> DataFrame:
    """Bars from a trade stream; a bar appears once the watermark has passed its end.

    Trades later than ``delay`` are not in their bar: part them by ``late_sink`` first, which keeps and counts them, or
    use ``bars_sink``, which repairs bars.
    """
    at = F.struct("ts", "trade_id")
    w = F.window("ts", f"{seconds} seconds")
    return (
        trades.withWatermark("ts", delay)
        .groupBy("instrument", w.alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"))
        .select("instrument", F.col("w.start").alias("open_time"), F.col("w.end").alias("close_time"), "open", "high", "low", "close", "volume")
    )


def route_to_robots(candles: DataFrame, robots: DataFrame) -> DataFrame:
    """Every candle to every running robot of its instrument and timeframe (stream-static join); robots that crowd on a
    series are spread over tasks."""
    running = robots.filter("status = 'running'").select("robot_id", "instrument", "timeframe", "candidate_kinds")
    return crowded_join(candles, running, ["instrument", "timeframe"])


# --- keyed state ------------------------------------------------------------------------------
def warmup(history: DataFrame, bars: int = WARMUP_BARS) -> DataFrame:
    """The newest candles of each series; a bounded list per key (k smallest by negative time)."""
    from pyspark.sql import Window

    newest = Window.partitionBy("instrument", "timeframe").orderBy(F.col("close_time").desc())
    # The optimizer turns this filter into a per-task group limit, so only k rows per key are shuffled.
    return history.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= bars).drop("_n")


def _bars(candles: DataFrame) -> DataFrame:
    return candles.select(*[F.col(c).cast("double").alias(c) if c in ("open", "high", "low", "close", "volume") else F.col(c) for c in X.BAR])


def feature_sink(path: str, config: X.FeatureConfig = X.FeatureConfig(), history: DataFrame | None = None, derive: Callable[[DataFrame], DataFrame] | None = None,
                 layout: str = "blocks") -> Callable[[DataFrame, int], None]:
    """All indicator columns of each batch's closed candles to ``rows``; ``history`` warms the state up before the first.

    A batch runs through the block operators together with the state of its series, a table of some bars a series
    (``features.continued``): no series is gone through row by row, and a busy one is spread over tasks. Bars that
    are there already are left out; older ones come out marked ``late``, without features. ``derive`` makes other rows
    of those of a batch. A batch that runs again starts from the state before it and writes the same.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, f"{path}/state") if v < batch_id]
        none = spark.createDataFrame([], X.STATE_DDL)
        if before:
            state = spark.read.schema(X.STATE_DDL).parquet(f"{path}/state/v={before[-1]}")
        else:
            state = none if history is None else stable(X.continued(_bars(warmup(history)), none, config, layout=layout)[1])
        newest = state.groupBy(*X.KEYS).agg(F.max("close_time").alias("_newest"))
        # One row of a bar, whatever came twice.
        values = [c for c in X.BAR if c not in (*X.KEYS, "close_time")]
        once = _bars(batch).groupBy(*X.KEYS, "close_time").agg(F.min(F.struct(*values)).alias("_b")).select(*X.KEYS, "close_time", "_b.*").select(*X.BAR)
        marked = same_key_join(once, newest, X.KEYS, "left")
        late = F.coalesce(F.col("close_time") < F.col("_newest"), F.lit(False))
        rows, after = X.continued(marked.filter("_newest IS NULL OR close_time > _newest").select(*X.BAR), state, config, layout=layout)
        out = rows.withColumn("late", F.lit(False)).unionByName(marked.filter(late).select(*X.BAR, F.lit(True).alias("late")), allowMissingColumns=True)
        (derive(out) if derive else out).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{path}/state/v={batch_id}")
        for old in before[:-1]:
            lake.remove(spark, f"{path}/state/v={old}")

    return write


def candidate_rows(features: DataFrame) -> DataFrame:
    """Candidates of all six kinds from one batch of streamed features.

    A batch is read six times; readers of a stream would each keep the indicator state.
    """
    ready = features.filter("NOT late").drop("late").withColumns({"z_score": F.col("zscore"), "mean": F.col("sma")})
    parts = [
        G.crossover_rows(ready), G.momentum_rows(ready), G.reversion_rows(ready), G.statistical_mean_reversion(ready), G.quant_momentum(ready), G.breakout_rows(ready),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def candidate_sink(path: str, layout: str = "blocks") -> Callable[[DataFrame, int], None]:
    """``feature_sink`` of candidates."""
    def derive(features: DataFrame) -> DataFrame:
        return candidate_rows(stable(features))

    return feature_sink(path, derive=derive, layout=layout)


_S, _D, _L, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()
def order_stream(rows: DataFrame, disabled: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """The orders that streamed signals ask for: ``rows`` are ``ledger_rows`` with ``robot_id``. Stateless: entries of
    disabled or unselected strategies go, sizes and costs are columns of each row."""
    return admit(rows, disabled, selection).filter("entry IS NOT NULL OR force_exit")


def admit(rows: DataFrame, disabled: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Take away the long entries of disabled strategies and of those not selected for their robot;
    positions of the latter are to be closed."""
    off = rows.join(disabled.select("strategy_id", F.lit(True).alias("_off")), "strategy_id", "left")
    barred, force = F.coalesce("_off", F.lit(False)), F.lit(False)
    if selection is not None:
        off = off.join(selection.select("robot_id", F.col("selected").alias("_selected")), "robot_id", "left")
        force = F.coalesce(F.col("_selected") != F.col("strategy_id"), F.lit(False))
        barred = barred | force
    entry = F.when((F.col("entry") == "long") & barred, F.lit(None)).otherwise(F.col("entry"))
    return off.withColumns({"entry": entry, "force_exit": force}).select(*rows.columns)


QUOTED = S.table(("symbol", _S), ("uid", _L), ("timestamp_ms", _L), ("status", _S), *[(n, _D) for n in S.GRID_FEATURES])


# State of ``book_sink``: where each book stands with its newest quotes and its levels, and the trades and the order flow still in a window.
BOOK_DDL = "symbol string, last_uid bigint, segment bigint, seeded boolean, eff_ms bigint, " + ", ".join(f"{q} double" for q in books.QUOTES)
TAPE_DDL = "symbol string, trade_id bigint, timestamp_ms bigint, quantity double, is_buy boolean"
FLOW_DDL = "symbol string, eff_ms bigint, ofi decimal(18,8)"


def book_sink(path: str, window_seconds: int = WINDOW_SECONDS, depth: int = DEPTH, layout: str = "blocks") -> Callable[[DataFrame, int], None]:
    """Features after each applied book event to ``rows``, gaps as rows of status ``gap``, unseeded books as ``unseeded``.

    Events: symbol, kind (0 snapshot, 1 delta, 2 trade), uid, first_uid, t (ms), bids, asks, quantity, is_buy. A batch
    runs through the block operators: the book a symbol has opens it as an event of its own, so gaps and order flow
    across batches show as those within one, and a busy symbol is spread over tasks. Book events follow their ids,
    whatever their stamps say; updates the book has already are left out. A row sees only trades before its own time,
    as far as they have come. Kept are one book a symbol and what is still in its window; the state before the last
    batch stays for one that runs again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        side = batch.schema["bids"].dataType
        shapes = {"book": T.StructType([*T.StructType.fromDDL(BOOK_DDL).fields, T.StructField("bids", side), T.StructField("asks", side)]),
                  "tape": T.StructType.fromDDL(TAPE_DDL), "flow": T.StructType.fromDDL(FLOW_DDL)}
        before = [v for v in _versions(spark, f"{path}/book") if v < batch_id]

        def kept(part: str) -> DataFrame:
            return spark.read.schema(shapes[part]).parquet(f"{path}/{part}/v={before[-1]}") if before else spark.createDataFrame([], shapes[part])

        known, earlier = kept("book"), kept("flow")
        at = known.select("symbol", F.when(F.col("seeded"), F.col("last_uid")).alias("_last"))
        new = batch.filter("kind <> 2").join(at, "symbol", "left").filter(~F.coalesce(F.col("uid") < F.col("_last"), F.lit(False)))
        snapshots = new.filter("kind = 0").select("symbol", F.col("uid").alias("last_update_id"), F.col("t").alias("captured_at_ms"), "bids", "asks")
        deltas = new.filter("kind = 1").select("symbol", F.col("first_uid").alias("first_update_id"), F.col("uid").alias("final_update_id"), F.col("t").alias("event_time_ms"), "bids", "asks")
        seen = books.continued(known, snapshots, deltas, layout)
        # A book read again after a gap still does not go back in time.
        clock = known.select("symbol", F.col("eff_ms").alias("_eff"))
        seen = stable(seen.join(clock, "symbol", "left").withColumn("eff_ms", F.greatest("eff_ms", "_eff")).drop("_eff"))
        # Order flow also goes on across a gap, so a broken book leaves its last quotes at place 0.
        left = known.filter("NOT seeded").select("symbol", F.lit(0).cast("long").alias(books.POS), *books.QUOTES)
        quoted = books.quotes(seen, depth).select("symbol", books.POS, "uid", "ms", "eff_ms", *books.QUOTES).unionByName(left, allowMissingColumns=True)
        flow = stable(books.with_flow(quoted, [books.POS], layout))
        tape = kept("tape").unionByName(batch.filter("kind = 2").select("symbol", F.col("uid").alias("trade_id"), F.col("t").alias("timestamp_ms"), "quantity", "is_buy"))
        own = flow.filter(F.col(books.POS) > 0).join(seen.filter("carried").select("symbol", books.POS), ["symbol", books.POS], "left_anti")
        applied = books.rolled(own, tape, window_seconds, layout, earlier).withColumn("status", F.lit("applied"))
        lost = seen.filter("status IN ('gap', 'broken', 'unseeded')").select("symbol", "uid", F.col("ms").alias("timestamp_ms"), F.when(F.col("status") == "gap", "gap").otherwise("unseeded").alias("status"))
        applied.unionByName(lost, allowMissingColumns=True).select(*QUOTED.names).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

        def levels(is_bid: bool):
            return F.collect_list(F.when(F.col("is_bid") == is_bid, F.struct("price", "quantity"))).cast(side)

        sides = books.full_book(seen).groupBy("symbol").agg(levels(True).alias("bids"), levels(False).alias("asks"))
        none = F.array().cast(side)
        newest = flow.groupBy("symbol").agg(F.max_by(F.struct(*books.QUOTES), books.POS).alias("_q")).select("symbol", "_q.*")
        after = stable(books.continuity(known, seen).join(newest, "symbol", "left").join(sides, "symbol", "left").withColumns({c: F.coalesce(c, none) for c in ("bids", "asks")}).select(*shapes["book"].names))
        mark = after.select("symbol", (F.col("eff_ms") - window_seconds * 1000).alias("_from"))

        def still(rows: DataFrame, clock: str) -> DataFrame:
            return rows.join(mark, "symbol", "left").filter(F.coalesce(F.col(clock) >= F.col("_from"), F.lit(True))).drop("_from")

        still(tape, "timestamp_ms").write.mode("overwrite").parquet(f"{path}/tape/v={batch_id}")
        still(own.filter("ofi IS NOT NULL").select("symbol", "eff_ms", "ofi").unionByName(earlier), "eff_ms").write.mode("overwrite").parquet(f"{path}/flow/v={batch_id}")
        # Written last: a batch counts as done by it.
        after.write.mode("overwrite").parquet(f"{path}/book/v={batch_id}")
        for old in before[:-1]:
            for part in ("book", "flow", "tape"):
                lake.remove(spark, f"{path}/{part}/v={old}")

    return write


# --- sinks ------------------------------------------------------------------------------------
def start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Run a batch writer per micro-batch: on a clock, or over what is there now."""
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Rows of a batch in a folder of that batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[2:]) for n in lake.children(spark, path) if n.startswith("v=") and lake.exists(spark, f"{path}/{n}/_SUCCESS"))


def keyed_sink(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """The latest row of every key as one table: each batch writes a new version of it, readers take the newest.

    A batch that runs again starts from the version before it. The version before the last stays for readers under way.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < batch_id]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v={before[-1]}")) if before else batch
        latest_per(rows, keys, order).write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        for old in before[:-1]:
            lake.remove(spark, f"{path}/v={old}")

    return write


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={_versions(spark, path)[-1]}")


def tick_sink(path: str, app: str = "s", layout: str = "blocks") -> Callable[[DataFrame, int], None]:
    """Routed messages of a batch as one commit of the tick lake: all four kinds, the gaps found, and where books stand.

    The state of a symbol is one row, written by the commit of the batch that it is the state after; a batch that runs
    again finds its commit and adds nothing, one that was lost before its commit left nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if commits.applied(spark, path, app) >= batch_id:
            return
        batch.persist()
        parts = messages.route(batch)
        # Read for their levels and for their places: parsed and written once. So are the places, which the log and the state are read from.
        deltas, snapshots = stable(parts["book_deltas"]), stable(parts["book_snapshots"])
        known = lake.read_ticks(spark, path, "continuity")
        # A place depends on the ids alone: the levels stay where they are.
        bare = [rows.withColumns({side: F.array().cast(rows.schema[side].dataType) for side in ("bids", "asks")}) for rows in (snapshots, deltas)]
        seen = stable(books.continued(known, *bare, layout))
        lake.append_all({
            "trades": parts["trades"], "book_ticker": parts["book_ticker"],
            "book_deltas": books.flatten_levels(deltas, ["symbol", "first_update_id", "final_update_id", "event_time_ms"]),
            "book_snapshots": books.flatten_levels(snapshots, ["symbol", "last_update_id", "captured_at_ms"]),
            "desync": books.desyncs(seen), "continuity": books.continuity(known, seen)}, path, f"{app}-{batch_id}", replace=("continuity",))
        batch.unpersist()

    return write


def routed_sink(path: str, read_robots: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Route a batch to the robots there are *now*: the robot table is read again for every batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        route_to_robots(batch, read_robots()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


ROBOT = ("robot_id", "instrument", "timeframe", "candidate_kinds")


def running_at(log: DataFrame, at) -> DataFrame:
    """Of a table of robots with their changes (``ROBOT``, status, changed_at), those that run at ``at``."""
    newest = F.max_by(F.struct(*ROBOT[1:], "status"), F.struct("changed_at", "status")).alias("_r")
    return log.filter(F.col("changed_at") <= F.lit(at)).groupBy("robot_id").agg(newest).select("robot_id", "_r.*").filter("status = 'running'").select(*ROBOT)


def robot_sync_sink(path: str, read_log: Callable[[], DataFrame], history: DataFrame | None = None, bars: int = WARMUP_BARS) -> Callable[[DataFrame, int], None]:
    """Closed candles to the robots that run, which may start and stop between batches; ``rows`` are robot's candles.

    The table of robots and their changes is read again for every batch and taken as of the batch's newest candle, so a
    batch that runs again sees the same robots. A robot that starts gets the newest ``bars`` candles of its series from
    before the batch first (``warmup`` true); one that stops, or changes its series, is taken out of ``active``, and a
    robot that starts again is warmed up again. If none runs, those there are stay. Kept are one row a robot and
    ``bars`` candles a series; the state before the last batch stays for one that runs again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, f"{path}/active") if v < batch_id]
        closed = stable(batch.filter("is_closed"))
        at = closed.agg(F.max("close_time")).first()[0]
        if before:
            active = spark.read.parquet(f"{path}/active/v={before[-1]}")
            newest = spark.read.schema(closed.schema).parquet(f"{path}/newest/v={before[-1]}")
        else:
            active = read_log().select(*ROBOT).limit(0)
            newest = closed.limit(0) if history is None else warmup(history.select(*closed.columns), bars)
        wanted = active if at is None else running_at(read_log(), at)
        wanted = stable(wanted if wanted.limit(1).count() else active)
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ROBOT[:3]]
        added = wanted.alias("a").join(active.alias("b"), same, "left_anti")
        live = crowded_join(closed, wanted, ["instrument", "timeframe"]).withColumn("warmup", F.lit(False))
        first = crowded_join(newest, added, ["instrument", "timeframe"]).withColumn("warmup", F.lit(True))
        first.unionByName(live).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        warmup(newest.unionByName(closed), bars).write.mode("overwrite").parquet(f"{path}/newest/v={batch_id}")
        # Written last: a batch counts as done by it.
        wanted.write.mode("overwrite").parquet(f"{path}/active/v={batch_id}")
        for old in before[:-1]:
            for part in ("active", "newest"):
                lake.remove(spark, f"{path}/{part}/v={old}")

    return write
