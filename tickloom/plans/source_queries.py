"""Registered queries of message parsing, lakes and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import candles as C
from tickloom.operators import books as B
from tickloom.plans import book_queries as BQ
from tickloom.plans.adapters import TRADES_SQL, bars, bars_sql, closed_trades, load, r6, us
from tickloom.plans.candle_queries import ARRIVALS_SQL, REPORT_SQL, audited, ohlc_sql, sized
from tickloom.plans.ledger_queries import DIAGNOSED_SQL, REPORTS_SQL, report_figures, report_figures_sql, reports, trade_reports
from tickloom.plans.registry import Registry
from tickloom.operators import sweep as W
from tickloom.session import scratch_path
from tickloom.sources import lake as K
from tickloom.sources import messages as N

R = Registry()


def raw(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Events as combined-stream messages: clicks are trades, views depth updates, purchases tickers,
    sign-ups klines; every error is a trade message cut short."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("p", F.col("value").cast("decimal(18,2)").cast("string"))
    trade = F.to_json(F.struct(F.lit("AAAUSDT").alias("s"), F.col("event_id").alias("t"), F.col("p"), F.col("k").alias("q"), F.unix_millis("ts").alias("T"), (F.col("user_id") % 2 == 0).alias("m")))
    depth = F.to_json(F.struct(F.lit("AAAUSDT").alias("s"), F.col("event_id").alias("U"), (F.col("event_id") + 1).alias("u"), F.array(F.array("p", "k")).alias("b"), F.array().cast("array<array<string>>").alias("a")))
    ticker = F.to_json(F.struct(F.col("event_id").alias("u"), F.lit("AAAUSDT").alias("s"), F.col("p").alias("b"), F.col("k").alias("B"), (F.col("value") + 1).cast("decimal(18,2)").cast("string").alias("a"), F.col("k").alias("A")))
    kline = F.to_json(F.struct(F.lit("AAAUSDT").alias("s"), F.struct(F.unix_millis("ts").alias("t"), (F.unix_millis("ts") + 60000).alias("T"), F.lit("1m").alias("i"), F.col("p").alias("o"), F.col("p").alias("h"),
                                                                    F.col("p").alias("l"), F.col("p").alias("c"), F.col("k").alias("v"), (F.col("user_id") % 2 == 0).alias("x")).alias("k")))
    kind = F.col("event_type")
    stream = F.when(kind == "view", "aaausdt@depth@100ms").when(kind == "purchase", "aaausdt@bookTicker").when(kind == "signup", "aaausdt@kline_1m").otherwise("aaausdt@trade")
    payload = F.when(kind == "view", depth).when(kind == "purchase", ticker).when(kind == "signup", kline).when(kind == "error", F.substring(trade, 1, 25)).otherwise(trade)
    return e.select(stream.alias("stream"), payload.alias("payload"), F.col("ts").alias("received_at"), *keep)


PARSED = "CAST(value AS DOUBLE) AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, epoch_us(ts) // 1000 AS ms"
R.add("norm_trade", lambda s, d: N.route(raw(s, d))["trades"].select("exchange_trade_id", r6("price"), r6("quantity"), "is_buy", "timestamp_ms"),
      f"SELECT CAST(event_id AS VARCHAR) AS exchange_trade_id, round(v, 6) AS price, k AS quantity, user_id % 2 <> 0 AS is_buy, ms AS timestamp_ms FROM (SELECT *, {PARSED} FROM events) WHERE event_type = 'click'")
R.add("norm_depth_delta", lambda s, d: N.route(raw(s, d))["book_deltas"].select("first_update_id", "final_update_id", "event_time_ms", r6(F.element_at("bids", 1).price, "price"), F.size("asks").cast("long").alias("asks")),
      f"SELECT event_id AS first_update_id, event_id + 1 AS final_update_id, ms AS event_time_ms, round(v, 6) AS price, 0::BIGINT AS asks FROM (SELECT *, {PARSED} FROM events) WHERE event_type = 'view'")
R.add("norm_book_ticker", lambda s, d: N.route(raw(s, d))["book_ticker"].select("update_id", r6("bid_price"), r6("bid_qty"), r6("ask_price"), "timestamp_ms"),
      f"SELECT event_id AS update_id, round(v, 6) AS bid_price, k AS bid_qty, round(v + 1, 6) AS ask_price, ms AS timestamp_ms FROM (SELECT *, {PARSED} FROM events) WHERE event_type = 'purchase'")
R.add("norm_ws_kline", lambda s, d: N.route(raw(s, d))["klines"].select("symbol", "timeframe", us("open_time"), us("close_time"), r6("close"), r6("volume"), "is_closed"),
      f"SELECT 'AAAUSDT' AS symbol, '1m' AS timeframe, ms * 1000 AS open_time_us, (ms + 60000) * 1000 AS close_time_us, round(v, 6) AS close, k AS volume, user_id % 2 = 0 AS is_closed FROM (SELECT *, {PARSED} FROM events) WHERE event_type = 'signup'")
R.add("route_envelope", lambda s, d: raw(s, d).groupBy(F.coalesce(N.route_of(F.col("stream")), F.lit("unknown")).alias("route")).agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.get_json_object("payload", "$.s").isNull()).alias("malformed")),
      "SELECT CASE event_type WHEN 'view' THEN 'book_deltas' WHEN 'purchase' THEN 'book_ticker' WHEN 'signup' THEN 'klines' ELSE 'trades' END AS route, count(*) AS messages, count(*) FILTER (event_type = 'error') AS malformed FROM events GROUP BY 1")


def rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir, "1h")
    t = F.unix_millis("open_time").cast("string")
    cells = F.array(t, *[F.col(c).cast("string") for c in N.PRICES], F.unix_millis("close_time").cast("string"), *[F.lit("0")] * 5)
    return b.select(F.col("instrument").alias("symbol"), "timeframe", F.to_json(cells).alias("payload"))


R.add("norm_rest_kline", lambda s, d: N.rest_klines(rest(s, d), F.lit("2024-01-15 12:00:00").cast("timestamp")).select("symbol", us("open_time"), r6("close"), r6("volume"), "is_closed"),
      f"WITH {bars_sql('1h')} SELECT instrument AS symbol, open_s * 1000000 AS open_time_us, round(close, 6) AS close, round(volume, 6) AS volume, close_s <= 1705320000 AS is_closed FROM bars")
R.add("norm_depth_snapshot", lambda s, d: N.depth_snapshots(BQ.snapshots(s, d).select("symbol", F.timestamp_millis("captured_at_ms").alias("received_at"), F.to_json(F.struct(
      F.col("last_update_id").alias("lastUpdateId"), *[F.transform(c, lambda x: F.array(x.price.cast("string"), x.quantity.cast("string"))).alias(c) for c in ("bids", "asks")])).alias("payload"))).select(
      "last_update_id", "captured_at_ms", r6(F.element_at("bids", 1).price, "best_bid"), r6(F.element_at("asks", -1).quantity, "last_ask_size")),
      "SELECT event_id AS last_update_id, epoch_us(ts) // 1000 AS captured_at_ms, 99.5::DOUBLE AS best_bid, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 5 AS last_ask_size FROM events WHERE event_type = 'signup'")


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    price = F.struct(F.lit("PRICE_FILTER").alias("filterType"), F.col("p_retailprice").cast("string").alias("tickSize"))
    lot = F.to_json(F.struct(F.lit("LOT_SIZE").alias("filterType"), F.when(F.col("p_size") % 2 == 0, "oops").otherwise(F.col("p_size").cast("string")).alias("stepSize"), F.lit("2").alias("minQty")))
    body = F.concat(F.lit('{"symbol":"'), F.col("p_partkey").cast("string"), F.lit('","filters":['), F.to_json(price), F.lit(","), lot, F.lit("]}"))
    return p.select(body.alias("payload"))


R.add("norm_exchange_info", lambda s, d: N.exchange_info(info(s, d)).select("symbol", *[r6(c) for c in N.DEFAULT_FILTERS]),
      "SELECT CAST(p_partkey AS VARCHAR) AS symbol, round(p_retailprice, 6) AS tick_size, CASE WHEN p_size % 2 = 0 THEN 0.0001 ELSE p_size END::DOUBLE AS lot_size, 2.0::DOUBLE AS min_quantity, 10.0::DOUBLE AS min_notional FROM part")


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").cast("decimal(38,18)").alias("price"),
        F.when(F.col("event_type") == "error", F.lit("0.123456789")).otherwise(F.lit("1.5")).cast("decimal(38,18)").alias("quantity"))
    good, bad = N.scale_guard(e, ["price", "quantity"])
    return good.select("event_id", F.lit(None).cast("string").alias("offending_column")).unionByName(bad.select("event_id", "offending_column"))


def poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw feed, and every event once more as a trade: errors with nine decimals, views of 10^11, clicks of 10^31."""
    e = load(spark, sf_dir, "events")
    price = F.when(F.col("event_type") == "error", "1.123456789").otherwise(F.lit("2.50000000000"))
    size = F.when(F.col("event_type") == "view", "100000000000").when(F.col("event_type") == "click", "1" + "0" * 31).otherwise(F.lit("1e2"))
    payload = F.to_json(F.struct(F.lit("AAAUSDT").alias("s"), F.col("event_id").alias("t"), price.alias("p"), size.alias("q"), F.unix_millis("ts").alias("T"), F.lit(True).alias("m")))
    return raw(spark, sf_dir).unionByName(e.select(F.lit("x@trade").alias("stream"), payload.alias("payload"), F.col("ts").alias("received_at")))


R.add("parse_quarantine", lambda s, d: N.quarantine(poisoned(s, d)),
      """SELECT route, count(*) AS messages, count(*) FILTER (bad) AS malformed FROM (
 SELECT CASE event_type WHEN 'view' THEN 'book_deltas' WHEN 'purchase' THEN 'book_ticker' WHEN 'signup' THEN 'klines' ELSE 'trades' END AS route, event_type = 'error' AS bad FROM events
 UNION ALL SELECT 'trades', event_type IN ('error', 'click') FROM events) GROUP BY 1 UNION ALL SELECT 'unknown', 0, 0 UNION ALL SELECT 'book_snapshots', 0, 0""")
R.add("exact_volumes", lambda s, d: N.route(poisoned(s, d))["trades"].groupBy("is_buy").agg(F.count(F.lit(1)).alias("trades"), F.sum("quantity").cast("string").alias("volume")),
      """SELECT is_buy, count(*) AS trades, CAST(CAST(sum(q) AS DECIMAL(38,8)) AS VARCHAR) AS volume FROM (
 SELECT user_id % 2 <> 0 AS is_buy, CAST(json_extract_string(props, '$.k') AS DECIMAL(38,8)) AS q FROM events WHERE event_type = 'click'
 UNION ALL SELECT false, CAST(CASE WHEN event_type = 'view' THEN 100000000000 ELSE 100 END AS DECIMAL(38,8)) FROM events WHERE event_type NOT IN ('error', 'click')) GROUP BY 1""")
R.add("decimal_scale_guard", guarded, "SELECT event_id, CASE WHEN event_type = 'error' THEN 'quantity' END AS offending_column FROM events")


# --- round trips through files --------------------------------------------------------------------
def candle_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "candles")
    K.write_candles(bars(spark, sf_dir, "1h"), path)
    return sized(K.read_candles(spark, path))


R.add("scan_candles", candle_trip, f"WITH {bars_sql('1h')} {ohlc_sql()}")
R.add("sink_candles", lambda s, d: candle_trip(s, d).groupBy("instrument", "timeframe").agg(F.count(F.lit(1)).alias("rows"), r6(F.sum("volume"), "volume")),
      f"WITH {bars_sql('1h')} SELECT instrument, timeframe, count(*) AS rows, round(sum(volume), 6) AS volume FROM bars GROUP BY ALL")


def ticks(spark: SparkSession, sf_dir: str) -> str:
    """The feed in a tick lake, in two commits: events of even numbers, then the others."""
    path = scratch_path(spark, "ticks")
    one = F.lit(1).cast("decimal(38,8)")
    for rest in range(2):
        def part(df: DataFrame, uid: str, rest: int = rest) -> DataFrame:
            return df.filter(F.col(uid) % 2 == rest)

        K.append_all({
            "trades": part(BQ.trades(spark, sf_dir), "trade_id").select("symbol", F.col("trade_id").cast("string").alias("exchange_trade_id"), F.col("quantity").alias("price"), "quantity", "is_buy", "timestamp_ms"),
            "book_deltas": B.flatten_levels(part(BQ.deltas(spark, sf_dir), "final_update_id"), ["symbol", "first_update_id", "final_update_id", "event_time_ms"]),
            "book_ticker": part(BQ.feed(spark, sf_dir), "event_id").select("symbol", F.col("event_id").alias("update_id"), *[one.alias(c) for c in ("bid_price", "bid_qty", "ask_price", "ask_qty")], F.col("ms").alias("timestamp_ms")),
            "book_snapshots": B.flatten_levels(part(BQ.snapshots(spark, sf_dir), "last_update_id"), ["symbol", "last_update_id", "captured_at_ms"])}, path)
    return path


def busiest_day(spark: SparkSession, sf_dir: str) -> str:
    """The day with the most events (ties: the first), to compact."""
    days = load(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).count()
    return str(days.orderBy(F.desc("count"), "day").first().day)


BUSIEST = "(SELECT CAST(ts AS DATE) FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def digested(spark: SparkSession, path: str) -> DataFrame:
    """Every kind by day: how many rows, and sums over all their columns."""
    parts = [K.read_ticks(spark, path, kind).groupBy(F.lit(kind).alias("kind"), F.col("date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(ids).cast("long").alias("ids"), F.sum(clock).cast("long").alias("times"), r6(F.sum("quantity" if kind != "book_ticker" else "ask_qty"), "sizes"))
        for kind, ids, clock in (("trades", F.col("exchange_trade_id").cast("long"), "timestamp_ms"), ("book_ticker", F.col("update_id"), "timestamp_ms"),
                                 ("book_deltas", F.col("final_update_id"), "event_time_ms"), ("book_snapshots", F.col("last_update_id"), "captured_at_ms"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def tick_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(spark, ticks(spark, sf_dir))


DIGEST_SQL = """WITH e AS (SELECT event_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, epoch_us(ts) // 1000 AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
 r AS (SELECT 'trades' AS kind, day, event_id, ms, k + 1 AS q FROM e UNION ALL SELECT 'book_ticker', day, event_id, ms, 1 FROM e
  UNION ALL SELECT 'book_deltas', day, event_id, ms, CASE WHEN k >= 10 THEN k ELSE 0 END FROM e WHERE event_type <> 'signup'
  UNION ALL SELECT 'book_snapshots', day, event_id, ms, k + i FROM e CROSS JOIN range(1, 6) x(i) CROSS JOIN range(2) y(s) WHERE event_type = 'signup')
 SELECT kind, day, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(ms) AS BIGINT) AS times, CAST(sum(q) AS DOUBLE) AS sizes FROM r GROUP BY ALL"""
R.add("sink_tick_lake", tick_trip, DIGEST_SQL)
R.add("scan_tick_day", lambda s, d: K.in_day_order("trades", K.read_ticks(s, ticks(s, d), "trades", "ALL", "2024-01-10")).select("exchange_trade_id", "timestamp_ms", r6("quantity")),
      "SELECT CAST(event_id AS VARCHAR) AS exchange_trade_id, epoch_us(ts) // 1000 AS timestamp_ms, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS quantity FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'")


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest day compacted twice: what each pass found and left."""
    path, day = ticks(spark, sf_dir), busiest_day(spark, sf_dir)
    first = K.compact_day(spark, path, "ALL", day)
    again = K.compact_day(spark, path, "ALL", day)
    return first.withColumn("pass", F.lit(1)).unionByName(again.withColumn("pass", F.lit(2))).select("pass", "kind", "rows", "files_after", "rewritten")


R.add("compact_day", compacted,
      f"""SELECT p AS pass, kind, count(*) AS rows, 1::BIGINT AS files_after, p = 1 AS rewritten FROM events CROSS JOIN (VALUES (1), (2)) x(p)
 CROSS JOIN (VALUES ('trades', 1), ('book_ticker', 1), ('book_deltas', 1), ('book_snapshots', 10)) y(kind, n), range(10) z(i)
 WHERE CAST(ts AS DATE) = {BUSIEST} AND i < n AND ((kind IN ('trades', 'book_ticker')) OR (kind = 'book_deltas') = (event_type <> 'signup')) GROUP BY ALL""")


def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole lake after a day was compacted and its last batch came again."""
    path = ticks(spark, sf_dir)
    last = BQ.trades(spark, sf_dir).select("symbol", F.col("trade_id").cast("string").alias("exchange_trade_id"), F.col("quantity").alias("price"), "quantity", "is_buy", "timestamp_ms")
    own = scratch_path(spark, "ticks")
    for _ in range(2):
        K.append_ticks("trades", last, own, "s-0")
        K.compact_day(spark, own, "ALL", busiest_day(spark, sf_dir))
    return digested(spark, path).filter("kind <> 'trades'").unionByName(digested(spark, own))


R.add("compacted_precedence", precedence, DIGEST_SQL)


def grid_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.plans.research_queries import grid

    path = scratch_path(spark, "grid")
    K.write_grid(grid(spark, sf_dir), path)
    return K.read_grid(spark, path).groupBy("symbol").agg(F.count(F.lit(1)).alias("points"), F.count("trade_imbalance").alias("with_tape"), r6(F.avg("mid_price"), "mid"))


def grid_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.plans.research_queries import grid

    path = scratch_path(spark, "grid")
    K.write_grid(grid(spark, sf_dir), path)
    return K.read_grid(spark, path).select("symbol", "timestamp_ms", r6("mid_price"), r6("volume_delta"))


R.add("scan_feature_grid", grid_scan, f"WITH {bars_sql('15m')} SELECT instrument AS symbol, open_s * 1000 AS timestamp_ms, round(close, 6) AS mid_price, CASE WHEN volume > 60 THEN round(volume - 100, 6) END AS volume_delta FROM bars")
R.add("sink_feature_grid", grid_trip, f"WITH {bars_sql('15m')} SELECT instrument AS symbol, count(*) AS points, count(*) FILTER (volume > 60) AS with_tape, round(avg(close), 6) AS mid FROM bars GROUP BY 1")


def desync(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "desync")
    g = B.gaps(BQ.sequenced(spark, sf_dir, lossy=True)).withColumn("kind", F.lit("sequence_gap"))
    K.append_desync(g, path)
    return K.read_desync(spark, path).select("symbol", "kind", "expected", "got", "at_ms")


R.add("desync_log", desync, BQ.R.sql["book_gap_detect"].replace("SELECT prev + 1 AS expected", "SELECT 'ALL' AS symbol, 'sequence_gap' AS kind, prev + 1 AS expected"))


def validation_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "validation")
    report = C.validation_report(audited(spark, sf_dir))
    K.write_json(report, path, ["timeframe"])
    return spark.read.schema(report.schema).json(path).drop("timeframe")


R.add("sink_validation_record", validation_trip, f"WITH {ARRIVALS_SQL} {REPORT_SQL}")


def report_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "reports")
    reports = trade_reports(spark, sf_dir).select(*W.RUN, "total_trades", "net_pnl")
    K.write_reports(reports, path)
    # A diagnosis of all runs beside them, which readers leave out by its folder.
    K.write_json(reports.agg(F.sum("net_pnl").alias("net_pnl")), f"{path}/symbol=none/timeframe=none/strategy_id=none/window=none")
    return K.read_reports(spark, path, reports.schema).filter("symbol <> 'none'").select("symbol", "window", "strategy_id", "total_trades", r6("net_pnl"))


R.add("sink_experiment_report", report_trip, f'WITH {DIAGNOSED_SQL} SELECT symbol, w AS "window", strategy_id, n AS total_trades, round(net, 6) AS net_pnl FROM diagnosed')


def reports_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored reports graded again, as a later process would."""
    path = scratch_path(spark, "reports")
    reports = trade_reports(spark, sf_dir)
    K.write_reports(reports, path)
    return W.diagnostics(K.read_reports(spark, path, reports.schema)).groupBy("class").agg(F.count(F.lit(1)).alias("runs"))


R.add("scan_reports", reports_scanned, f"WITH {DIAGNOSED_SQL} SELECT class, count(*) AS runs FROM diagnosed GROUP BY 1")


def csv_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades through CSV; the note holds quotes, commas and a line break."""
    path = scratch_path(spark, "trades-csv")
    t = closed_trades(spark, sf_dir).select("position_id", "strategy_id", F.concat(F.lit('said "buy", then '), "instrument").alias("note"), F.col("pnl_net").cast("double").alias("pnl_net"))
    K.write_csv(t, path)
    return K.read_csv(spark, path, t.schema).select("position_id", "strategy_id", "note", r6("pnl_net"))


R.add("sink_trades_csv", csv_trip, f"""WITH {TRADES_SQL} SELECT position_id, strategy_id, 'said "buy", then ' || instrument AS note, round(CAST(pnl_net AS DOUBLE), 6) AS pnl_net FROM trades""")


def summary_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 28 columns of all runs through the file; what a run lacks is a dash there."""
    path = scratch_path(spark, "summary")
    table = K.summary_table(reports(spark, sf_dir))
    K.write_csv(table, path, "-")
    back = K.read_csv(spark, path, table.schema, "-")
    return back.select(*W.RUN, *report_figures(back, SUMMARY_NAMES))


SUMMARY_NAMES = {column: name for name, column in K.REPORT_NAMES.items()}
R.add("sink_summary_csv", summary_trip,
      f"""WITH {REPORTS_SQL} SELECT symbol, timeframe, "window", strategy_id, {', '.join(c for c in K.SUMMARY_COLUMNS[4:])} FROM (SELECT symbol, timeframe, span AS "window", strategy_id, {report_figures_sql(SUMMARY_NAMES)} FROM reports)""")


def signal_report_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.operators.research import round_trip_cost
    from tickloom.plans.research_queries import grid

    path = scratch_path(spark, "signals")
    table = round_trip_cost(grid(spark, sf_dir))
    K.write_json(table, path)
    return spark.read.schema(table.schema).json(path).select("symbol", "grid_points", r6("round_trip_cost"))


def _cost_sql() -> str:
    from tickloom.plans.research_queries import R as research

    return research.sql["sig_round_trip_cost"]


R.add("sink_signal_report", signal_report_trip, _cost_sql())


def append_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "trades")
    t = closed_trades(spark, sf_dir).select("position_id", "strategy_id", "pnl_net")
    K.append_table(t.filter("pnl_net > 0"), path, ["strategy_id"])
    K.append_table(t.filter("NOT pnl_net > 0"), path, ["strategy_id"])
    return spark.read.schema(t.schema).parquet(path).groupBy("strategy_id").agg(F.count(F.lit(1)).alias("rows"), r6(F.sum("pnl_net"), "net"))


R.add("ops_table_append", append_trip, f"WITH {TRADES_SQL} SELECT strategy_id, count(*) AS rows, round(CAST(sum(pnl_net) AS DOUBLE), 6) AS net FROM trades GROUP BY 1")


def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rebuilt from the stored level rows of all days."""
    path = ticks(spark, sf_dir)
    seq, tape_ = B.load_events(*[K.read_ticks(spark, path, kind) for kind in ("trades", "book_deltas", "book_snapshots")])
    book = seq.select("uid", F.col("kind").cast("long").alias("kind"), "segment")
    return book.unionByName(tape_.select(F.col("trade_id").alias("uid"), F.lit(2).cast("long").alias("kind"), F.lit(0).cast("long").alias("segment")))


R.add("load_day_events", reloaded,
      f"WITH {BQ.FEED_SQL} SELECT uid, CASE WHEN snap THEN 0 ELSE 1 END::BIGINT AS kind, seg AS segment FROM ev UNION ALL SELECT uid, 2, 0 FROM feed")
