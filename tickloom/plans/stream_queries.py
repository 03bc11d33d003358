"""Registered queries that run a stream over whole tables and read back what it wrote."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import ledger as L
from tickloom.operators import signals as S
from tickloom.plans import book_queries as BQ
from tickloom.plans import candle_queries as CQ
from tickloom.plans.adapters import TAPE_SQL, bars, bars_sql, load, r6, tape, tape_layout, us
from tickloom.plans.ledger_queries import SIGNALS_SQL, units
from tickloom.plans.registry import Registry
from tickloom.plans.source_queries import busiest_day, raw
from tickloom.session import scratch_path
from tickloom.sources import lake as K
from tickloom.sources import published
from tickloom.streaming import jobs as J

R = Registry()


class Feed:
    """A table that lands in parts, each written in parallel, and is read as a stream; a part is a micro-batch."""

    def __init__(self, name: str, *parts: DataFrame) -> None:
        self.spark, self.parts, self.path = parts[0].sparkSession, parts, scratch_path(parts[0].sparkSession, name)
        self.land(0)
        self.stream = self.spark.readStream.schema(parts[0].schema).parquet(self.path)

    def land(self, part: int) -> None:
        self.parts[part].write.mode("append").parquet(self.path)

    def played(self, stream: DataFrame, sink: Callable[[str], Callable[[DataFrame, int], None]] = J.table_sink) -> str:
        """What the sink wrote once every part has come: the query stops after each and goes on where it stood."""
        path, progress = scratch_path(self.spark, "sink"), scratch_path(self.spark, "progress")
        for part in range(len(self.parts)):
            if part:
                self.land(part)
            J.start(stream, sink(path), progress).awaitTermination()
        return path

    def result(self, stream: DataFrame) -> DataFrame:
        return self.spark.read.schema(stream.schema).parquet(self.played(stream))


def halves(df: DataFrame, clock: str) -> tuple[DataFrame, DataFrame]:
    """The rows before the middle of the table's time, and the others."""
    ends = df.agg(F.min(F.unix_micros(clock)), F.max(F.unix_micros(clock))).first()
    early = F.unix_micros(clock) < ((ends[0] or 0) + (ends[1] or 0)) // 2
    return df.filter(early), df.filter(~early)


KLINES = "SELECT 'AAAUSDT' AS instrument, ms * 1000 AS open_time_us, round(v, 6) AS close FROM (SELECT *, CAST(value AS DOUBLE) AS v, epoch_us(ts) // 1000 AS ms FROM events) WHERE event_type = 'signup'"


def two_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kline feed, and the same a second time as five-minute bars."""
    one = raw(spark, sf_dir)
    feeds = [Feed("raw", one), Feed("raw", one.withColumn("payload", F.regexp_replace("payload", '"i":"1m"', '"i":"5m"')))]
    return feeds[0].result(J.candle_union([J.candle_stream(f.stream) for f in feeds]))


def repeated_and_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the bars first, then all of them: every bar of the first half is two weeks late."""
    b = bars(spark, sf_dir, "1h")
    feed = Feed("bars", halves(b, "open_time")[1], b)
    return spark.read.parquet(f"{feed.played(feed.stream, J.closed_once_sink)}/rows")


R.add("stream_candles", lambda s, d: two_feeds(s, d).select("instrument", "timeframe", us("open_time"), r6("close")), f"SELECT instrument, timeframe, open_time_us, close FROM ({KLINES}) CROSS JOIN (VALUES ('1m'), ('5m')) t(timeframe)")
R.add("stream_closed_dedup", lambda s, d: CQ.sized(repeated_and_late(s, d)), f"WITH {bars_sql('1h')} {CQ.ohlc_sql()}")


def late_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth tick of the second half comes after all others; an hour is allowed."""
    t = tape(spark, sf_dir)
    early, rest = halves(t, "ts")
    feed = Feed("ticks", early, rest.filter("trade_id % 10 <> 0"), rest.filter("trade_id % 10 = 0"))
    path = feed.played(feed.stream, lambda p: J.late_sink(p, "ts", 3600))
    return spark.read.parquet(f"{path}/rows").select("instrument", F.lit(False).alias("late")).unionByName(spark.read.parquet(f"{path}/late").select("instrument", F.lit(True).alias("late")))


R.add("late_data", lambda s, d: late_ticks(s, d).groupBy("instrument", "late").agg(F.count(F.lit(1)).alias("n")),
      f"""WITH {TAPE_SQL}, m AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS mid FROM tape),
 parted AS (SELECT *, epoch_us(ts) >= mid AND trade_id % 10 = 0 AS last FROM tape, m), mark AS (SELECT max(ts) AS newest FROM parted WHERE NOT last)
 SELECT instrument, last AND ts < newest - INTERVAL 1 HOUR AS late, count(*) AS n FROM parted, mark GROUP BY ALL""")


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published hourly bars of the same ticks, late ones included: they equal those of the whole tape."""
    t = tape(spark, sf_dir)
    early, rest = halves(t, "ts")
    feed = Feed("ticks", early, rest.filter("trade_id % 10 <> 0"), rest.filter("trade_id % 10 = 0"))
    return published.read_bars(spark, feed.played(feed.stream, lambda p: J.bars_sink(p, "1h")))


R.add("late_repair", lambda s, d: repaired(s, d).select("instrument", us("open_time"), *[r6(c) for c in ("open", "high", "low", "close", "volume")], "trades", "repaired"),
      f"""WITH {bars_sql('1h')}, m AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS mid FROM tape),
 parts AS (SELECT instrument, open_s, count(*) AS trades, count(DISTINCT CASE WHEN epoch_us(ts) < mid THEN 0 WHEN trade_id % 10 <> 0 THEN 1 ELSE 2 END) > 1 AS repaired FROM keyed, m GROUP BY ALL)
 SELECT instrument, open_s * 1000000 AS open_time_us, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, trades, repaired
 FROM bars JOIN parts USING (instrument, open_s)""")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, order = ["instrument"], ["close_time"]
    early, rest = halves(bars(spark, sf_dir, "1h").select("instrument", "close_time", "close"), "close_time")
    feed = Feed("bars", rest, early)
    path = feed.played(feed.stream, lambda p: J.keyed_sink(p, keys, order))
    return J.read_keyed(spark, path).select("instrument", us("close_time"), r6("close"))


R.add("stream_marks", marks, f"WITH {bars_sql('1h')} SELECT instrument, max(close_s) * 1000000 AS close_time_us, round(max_by(close, close_s), 6) AS close FROM bars GROUP BY instrument")


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as robots, each on the event type its nation number points at."""
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    return load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("robot_id"), F.element_at(kinds, F.col("s_nationkey") % 5 + 1).alias("instrument"), F.lit("1h").alias("timeframe"),
        F.array(F.lit("momentum")).alias("candidate_kinds"), F.when(F.col("s_acctbal") > 0, "running").otherwise("stopped").alias("status"))


ROUTED_SQL = f"""WITH {bars_sql('1h')}, r AS (SELECT 'r' || CAST(s_suppkey AS VARCHAR) AS robot_id, list_extract(['click', 'error', 'purchase', 'signup', 'view'], s_nationkey % 5 + 1) AS instrument FROM supplier WHERE s_acctbal > 0)
 SELECT robot_id, count(*) AS bars, max(close_s) * 1000000 AS latest_us FROM bars JOIN r USING (instrument) GROUP BY robot_id"""


def per_robot(df: DataFrame) -> DataFrame:
    return df.groupBy("robot_id").agg(F.count(F.lit(1)).alias("bars"), F.max(F.unix_micros("close_time")).alias("latest_us"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = Feed("bars", bars(spark, sf_dir, "1h"))
    return per_robot(feed.result(J.route_to_robots(feed.stream, robots(spark, sf_dir))))


def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = Feed("bars", bars(spark, sf_dir, "1h"))
    return per_robot(spark.read.parquet(feed.played(feed.stream, lambda p: J.routed_sink(p, lambda: robots(spark, sf_dir)))))


R.add("stream_route", routed, ROUTED_SQL)
R.add("stream_hot_reload", reloaded, ROUTED_SQL)


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars in two halves, with robots that start and stop between them: suppliers in credit run first, then those
    in debt by more than 500 and those in credit by more than 1000. Candles by which each was warmed up, and those it got live."""
    b = bars(spark, sf_dir, "1h")
    early, rest = halves(b, "open_time")
    feed = Feed("bars", early, rest)
    balance = load(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("robot_id"), "s_acctbal")
    all_robots = robots(spark, sf_dir).join(balance, "robot_id")

    def at(when: Column, runs: Column) -> DataFrame:
        return all_robots.select(*J.ROBOT, F.when(runs, "running").otherwise("stopped").alias("status"), when.alias("changed_at"))

    # The second change is seen by the batch whose newest candle is behind it: the one of the later half.
    ends = b.agg(F.max("close_time")).first()[0]
    credit = F.col("s_acctbal")
    log = at(F.timestamp_seconds(F.lit(0)), credit > 0).unionByName(at(F.lit(ends).cast("timestamp"), (credit > 1000) | (credit < -500)))
    path = feed.played(feed.stream, lambda p: J.robot_sync_sink(p, lambda: log))
    return spark.read.parquet(f"{path}/rows").groupBy("robot_id").agg(
        F.count_if("warmup").alias("warmed"), F.count_if(~F.col("warmup")).alias("live"), F.max(F.unix_micros("close_time")).alias("latest_us"))


R.add("stream_robot_sync", synced,
      f"""WITH {bars_sql('1h')}, mid AS (SELECT (min(open_s) * 1000000 + max(open_s) * 1000000) // 2 AS mid FROM bars),
 halved AS (SELECT instrument, close_s, open_s * 1000000 < mid AS early, row_number() OVER (PARTITION BY instrument, open_s * 1000000 < mid ORDER BY open_s DESC) AS back FROM bars, mid),
 s AS (SELECT 'r' || CAST(s_suppkey AS VARCHAR) AS robot_id, list_extract(['click', 'error', 'purchase', 'signup', 'view'], s_nationkey % 5 + 1) AS instrument,
   s_acctbal > 0 AS before, s_acctbal > 1000 OR s_acctbal < -500 AS after FROM supplier),
 given AS (
  SELECT robot_id, close_s, false AS warmup FROM halved JOIN s USING (instrument) WHERE CASE WHEN early THEN before ELSE after END
  UNION ALL SELECT robot_id, close_s, true FROM halved JOIN s USING (instrument) WHERE early AND back <= 50 AND after AND NOT before)
 SELECT robot_id, count(*) FILTER (warmup) AS warmed, count(*) FILTER (NOT warmup) AS live, max(close_s) * 1000000 AS latest_us FROM given GROUP BY robot_id""")
SHOWN = ("sma", "zscore", "percent_b", "reg_r2", "rsi", "atr")


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = Feed("bars", *halves(bars(spark, sf_dir, "1h"), "open_time"))
    return spark.read.parquet(f"{feed.played(feed.stream, J.feature_sink)}/rows").select("instrument", us("close_time"), *[r6(c) for c in SHOWN])


R.add("stream_features", featured, CQ.R.sql["feature_snapshot"])


def warmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the table's time, live, on state warmed up with the fifty bars before it."""
    early, rest = halves(bars(spark, sf_dir, "1h"), "open_time")
    feed = Feed("bars", rest)
    path = feed.played(feed.stream, lambda p: J.feature_sink(p, history=early))
    return spark.read.parquet(f"{path}/rows").select("instrument", us("close_time"), r6("sma"), r6("zscore"))


R.add("stream_warmup", warmed,
      f"WITH {bars_sql('1h')}, f AS (SELECT *, {CQ.gated(CQ.M, 20)} AS sma, {CQ.Z} AS z FROM bars) SELECT instrument, close_s * 1000000 AS close_time_us, round(sma, 6) AS sma, round(z, 6) AS zscore FROM f WHERE open_s * 1000000 >= (SELECT (min(open_s) * 1000000 + max(open_s) * 1000000) // 2 FROM bars)")


def tumbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the streamed tape in three batches; the last holds one later tick, which closes them all."""
    t = tape(spark, sf_dir)
    early, rest = halves(t, "ts")
    end = t.agg((F.max("ts") + F.make_dt_interval(days=F.lit(2))).alias("ts")).withColumns({c: F.lit("end" if c == "instrument" else None).cast(t.schema[c].dataType) for c in t.columns if c != "ts"}).select(*t.columns)
    feed = Feed("tape", early, rest, end)
    return feed.result(J.tumbling_candles(feed.stream, 3600))


R.add("windows", lambda s, d: tumbled(s, d).select("instrument", us("open_time"), r6("open"), r6("high"), r6("low"), r6("close"), r6("volume")),
      f"WITH {bars_sql('1h')} SELECT instrument, open_s * 1000000 AS open_time_us, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM bars")


def robot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum of each event type as orders of one robot; the one on errors is disabled."""
    b = bars(spark, sf_dir, "1h")
    rows = L.ledger_rows(b, S.momentum(b, layout=tape_layout(spark, sf_dir)), units(b.select("instrument").distinct())).withColumn("robot_id", F.concat(F.lit("r-"), "instrument"))
    rows = rows.withColumn("strategy_id", F.concat("strategy_id", F.lit("@"), "instrument"))
    disabled = spark.createDataFrame([("momentum@error",)], "strategy_id string")
    feed = Feed("steps", rows)
    return feed.result(J.order_stream(feed.stream, disabled)).groupBy("robot_id", "entry").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("order_value"), "order_value"))


R.add("stream_robot_step", robot_orders,
      f"""WITH {SIGNALS_SQL}, sized AS (SELECT *, CAST(round(close * 100) AS BIGINT) AS c FROM signals WHERE entry IS NOT NULL AND NOT (entry = 'long' AND instrument = 'error'))
 SELECT 'r-' || instrument AS robot_id, entry, count(*) AS n, sum((1000000000 // c) * c) / 1000000.0::DOUBLE AS order_value FROM sized GROUP BY ALL""")


def book_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of one book, whose update ids are their numbers: sign-ups are snapshots of a level a side,
    errors were lost on the way, all others change a level. Clicks are also trades, purchases tickers."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("string"))
    uid, at = F.col("event_id"), F.col("ts").alias("received_at")
    sides = (F.array(F.array(F.lit("99.5"), "k")), F.array(F.array(F.lit("100.5"), "k")))
    snapshot = F.to_json(F.struct(uid.alias("lastUpdateId"), sides[0].alias("bids"), sides[1].alias("asks")))
    depth = F.to_json(F.struct(F.lit("AAAUSDT").alias("s"), uid.alias("U"), uid.alias("u"), sides[0].alias("b"), F.array().cast("array<array<string>>").alias("a")))
    books = e.filter("event_type <> 'error'").select(
        F.when(F.col("event_type") == "signup", "aaausdt@snapshot").otherwise("aaausdt@depth@100ms").alias("stream"), F.when(F.col("event_type") == "signup", snapshot).otherwise(depth).alias("payload"), at, uid)
    both = raw(spark, sf_dir, "event_id").filter(F.col("stream").endswith("@trade") | F.col("stream").endswith("@bookTicker"))
    return books.unionByName(both)


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts of the messages by their numbers into a tick lake, whose busiest day is compacted before it is read:
    counts and sums of all four kinds, and the log of gaps and of books read again."""
    m = book_messages(spark, sf_dir)
    ends = m.agg(F.min("event_id"), F.max("event_id")).first()
    third = F.floor((F.col("event_id") - (ends[0] or 0)) * 3 / ((ends[1] or 0) - (ends[0] or 0) + 1))
    feed = Feed("raw", *[m.filter(third == n).drop("event_id") for n in range(3)])
    path = feed.played(feed.stream, J.tick_sink)
    K.compact_day(spark, path, "AAAUSDT", busiest_day(spark, sf_dir))

    def summed(kind: str, ids: str, what: Column) -> DataFrame:
        rows = K.read_ticks(spark, path, kind)
        return rows.groupBy(F.lit(kind).alias("kind")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(ids).cast("long")).cast("long").alias("ids"), r6(F.sum(what), "amounts"))

    parts = [summed("trades", "exchange_trade_id", F.col("price") * F.col("quantity")), summed("book_ticker", "update_id", F.col("bid_price") + F.col("ask_price")),
             summed("book_deltas", "final_update_id", F.col("quantity")), summed("book_snapshots", "last_update_id", F.col("price") * F.col("quantity"))]
    log = K.read_ticks(spark, path, "desync").select("kind", F.lit(1).cast("long").alias("rows"), F.coalesce("got", "at_ms").alias("ids"), r6(F.col("expected"), "amounts"))
    return reduce(DataFrame.unionByName, [*parts, log])


R.add("stream_tick_ingest", ingested,
      """WITH e AS (SELECT event_id AS uid, event_type, epoch_us(ts) // 1000 AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(value AS DECIMAL(18,2)) AS v FROM events),
 b AS (SELECT *, event_type = 'signup' AS snap, lag(uid) OVER (ORDER BY uid) AS prev FROM e WHERE event_type <> 'error'),
 s AS (SELECT *, count(*) FILTER (snap) OVER (ORDER BY uid) AS seg, NOT snap AND uid > prev + 1 AS miss FROM b),
 gaps AS (SELECT seg, min(uid) AS uid, min(prev) AS prev FROM s WHERE miss AND seg > 0 GROUP BY seg),
 log AS (SELECT 'sequence_gap' AS kind, 1::BIGINT AS rows, uid AS ids, (prev + 1)::DOUBLE AS amounts FROM gaps
  UNION ALL SELECT 'scheduled_resnapshot', 1, ms, NULL FROM s WHERE snap AND seg > 1 AND seg - 1 NOT IN (SELECT seg FROM gaps))
 SELECT 'trades' AS kind, count(*) AS rows, CAST(sum(uid) AS BIGINT) AS ids, CAST(sum(v * k) AS DOUBLE) AS amounts FROM e WHERE event_type = 'click'
 UNION ALL SELECT 'book_ticker', count(*), CAST(sum(uid) AS BIGINT), CAST(sum(2 * v + 1) AS DOUBLE) FROM e WHERE event_type = 'purchase'
 UNION ALL SELECT 'book_deltas', count(*), CAST(sum(uid) AS BIGINT), CAST(sum(k) AS DOUBLE) FROM b WHERE NOT snap
 UNION ALL SELECT 'book_snapshots', 2 * count(*), CAST(2 * sum(uid) AS BIGINT), CAST(sum(200 * k) AS DOUBLE) FROM b WHERE snap
 UNION ALL SELECT * FROM log""")


def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d, t = BQ.snapshots(spark, sf_dir), BQ.deltas(spark, sf_dir), BQ.trades(spark, sf_dir)
    none = F.array().cast(s.schema["bids"].dataType)
    nothing = (F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("boolean").alias("is_buy"))
    return (
        s.select("symbol", F.lit(0).alias("kind"), F.col("last_update_id").alias("uid"), F.col("last_update_id").alias("first_uid"), F.col("captured_at_ms").alias("t"), "bids", "asks", *nothing)
        .unionByName(d.select("symbol", F.lit(1).alias("kind"), F.col("final_update_id").alias("uid"), F.col("first_update_id").alias("first_uid"), F.col("event_time_ms").alias("t"), "bids", "asks", *nothing))
        .unionByName(t.select("symbol", F.lit(2).alias("kind"), F.col("trade_id").alias("uid"), F.col("trade_id").alias("first_uid"), F.col("timestamp_ms").alias("t"), none.alias("bids"), none.alias("asks"),
                              F.col("quantity").cast("double").alias("quantity"), "is_buy"))
    )


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = Feed("book", book_events(spark, sf_dir))
    path = feed.played(feed.stream, lambda p: J.book_sink(p, BQ.WINDOW, layout=BQ.layout_of(spark, sf_dir)))
    return spark.read.parquet(f"{path}/rows").filter("status = 'applied'").select("uid", "timestamp_ms", *[r6(n) for n in BQ.NAMES])


R.add("stream_book_features", quoted, BQ.R.sql["micro_series"])
