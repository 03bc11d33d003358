"""Registered queries of scalar functions, joins and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import money as M
from tickloom.functions import text as X
from tickloom.operators import joins as N
from tickloom.operators import performance as P
from tickloom.operators import reports as Q
from tickloom.operators import signals as S
from tickloom.operators.series import as_of
from tickloom.plans import trade_queries as T
from tickloom.plans.adapters import KIND_SQL, KINDS, TAPE_SQL, TRADES_SQL, closed_trades, load, r6, tape, us
from tickloom.plans.registry import Registry
from tickloom.session import scratch_path
from tickloom.sources import lake as K

R = Registry()

# --- scalar functions over whole tables -------------------------------------------------------
def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("symbol"), F.col("p_retailprice").cast("decimal(18,8)").alias("price"),
        ((F.col("p_size") % 5 + 1).cast("decimal(18,8)") / 100).cast("decimal(18,8)").alias("tick"),
        ((F.col("p_size") % 7 + 1).cast("decimal(18,8)") / 1000).cast("decimal(18,8)").alias("lot"),
        (F.col("p_size").cast("decimal(18,8)") / 7).cast("decimal(18,4)").alias("quantity"),
    )


INSTRUMENTS_SQL = """instruments AS (
 SELECT p_partkey AS id, p_brand AS symbol, CAST(p_retailprice AS DECIMAL(18,8)) AS price, p_size % 5 + 1 AS tick_cents, p_size % 7 + 1 AS lot_mills,
  CAST(CAST(round(p_size * 10000 / 7.0::DOUBLE) AS BIGINT) AS DECIMAL(18,0)) * 0.0001::DECIMAL(5,4) AS quantity, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part)"""
R.add("notional", lambda s, d: instruments(s, d).select("id", r6(M.notional(F.col("price"), F.col("quantity")), "notional")),
      f"WITH {INSTRUMENTS_SQL} SELECT id, round(CAST(price * quantity AS DOUBLE), 6) AS notional FROM instruments")
# Half-even on integers: cents = n * tick + rest.
R.add("round_to_tick", lambda s, d: instruments(s, d).select("id", r6(M.round_to_tick(F.col("price"), F.col("tick")), "rounded")),
      f"""WITH {INSTRUMENTS_SQL} SELECT id, round(CASE WHEN 2 * (cents % tick_cents) > tick_cents OR (2 * (cents % tick_cents) = tick_cents AND (cents // tick_cents) % 2 = 1)
 THEN cents // tick_cents + 1 ELSE cents // tick_cents END * tick_cents / 100.0::DOUBLE, 6) AS rounded FROM instruments""")
R.add("floor_to_lot", lambda s, d: instruments(s, d).select("id", r6(M.floor_to_lot(F.col("quantity"), F.col("lot")), "floored")),
      f"WITH {INSTRUMENTS_SQL} SELECT id, round(CAST(floor(quantity * 1000) AS BIGINT) // lot_mills * lot_mills / 1000.0::DOUBLE, 6) AS floored FROM instruments")
R.add("assign_instrument_id", lambda s, d: instruments(s, d).select("id", X.name_uuid(F.col("symbol")).alias("instrument_id")),
      f"""WITH h AS (SELECT p_partkey AS id, sha1(unhex('{X.ID_NAMESPACE.replace('-', '')}') || encode(p_brand)) AS d FROM part)
 SELECT id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(('0x' || substr(d, 17, 1)) AS INTEGER) + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS instrument_id FROM h""")
R.add("exclude_test_rows", lambda s, d: load(s, d, "customer").withColumn("strategy_id", F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("smoke-test-"), "c_name")).otherwise(F.col("c_name")))
      .filter(~X.is_test_strategy(F.col("strategy_id"))).select("c_custkey", "strategy_id"),
      "SELECT c_custkey, c_name AS strategy_id FROM customer WHERE c_mktsegment <> 'BUILDING'")
R.add("strategy_kind_of", lambda s, d: closed_trades(s, d).select("position_id", X.strategy_kind(F.col("strategy_id")).alias("kind"), X.strategy_kind(F.col("instrument")).alias("bare")),
      f"WITH {TRADES_SQL} SELECT position_id, split_part(strategy_id, '::', 2) AS kind, instrument AS bare FROM trades")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows dressed as submitted orders; clicks lack a quote asset, errors a price."""
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_type") == "click", F.upper("event_type")).otherwise(F.concat(X.asset_code(F.concat(F.lit(" "), "event_type")), F.lit("/USD"))).alias("symbol"),
        F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value")).alias("price"),
        F.lit(1.0).alias("quantity"),
        (F.col("value") / 100).alias("confidence"),
        F.lit("s").alias("strategy_id"),
        F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.element_at(F.array(F.lit("1m"), F.lit("1h"), F.lit("2h")), (F.col("user_id") % 3 + 1).cast("int")).alias("timeframe"),
    )


def conform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = Q.conform(raw_rows(spark, sf_dir), Q.market_rules())
    return good.select("event_id", F.lit("").alias("violations")).unionByName(bad.select("event_id", F.concat_ws(",", "violations").alias("violations")))


R.add("conform_rows", conform_rows,
      """SELECT event_id, concat_ws(',', CASE WHEN event_type = 'click' THEN 'symbol' END, CASE WHEN event_type = 'error' THEN 'price' END,
 CASE WHEN value > 100 THEN 'confidence' END, CASE WHEN user_id % 3 = 2 THEN 'timeframe' END) AS violations FROM events""")


def compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are instruments (segment = asset class), order priorities are strategies."""
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("asset_class"),
        F.when(F.col("c_acctbal") > 0, F.array(F.lit("ohlcv"), F.lit("trades"))).otherwise(F.array(F.lit("ohlcv"))).alias("available_kinds"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"),
        F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("HOUSEHOLD")).alias("asset_classes"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("ohlcv"), F.lit("trades"))).otherwise(F.array(F.lit("ohlcv"))).alias("required_kinds"))
    return S.compatibility(o.join(c, "c_custkey")).select("o_orderkey", "incompatible")


R.add("compat_check", compat,
      """SELECT o_orderkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'asset_class:' || c_mktsegment
 WHEN o_orderstatus = 'F' AND NOT c_acctbal > 0 THEN 'data_kind:trades' END AS incompatible FROM orders JOIN customer ON o_custkey = c_custkey""")

# --- ledger-like tables -----------------------------------------------------------------------
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of which those closing after the 25th of a month still count as open."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position_id"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("_side"),
        (F.round(F.col("o_totalprice") * 100).cast("decimal(18,0)") / 100_000).cast("decimal(18,8)").alias("entry_price"))
    t = closed_trades(spark, sf_dir).join(o, "position_id")
    return t.withColumn("status", F.when(F.dayofmonth("closed_at") > 25, "open").otherwise("closed")).withColumn("side", F.col("_side")).drop("_side")


POSITIONS_SQL = f"""{TRADES_SQL},
 positions AS (
  SELECT t.* EXCLUDE (side), CASE WHEN day(closed_at) > 25 THEN 'open' ELSE 'closed' END AS status, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side,
   CAST(round(o_totalprice * 100) AS BIGINT) / 100000.0::DOUBLE AS entry_price FROM trades t JOIN orders ON position_id = o_orderkey),
 marks AS (
  SELECT 'i' || CAST(o_custkey % 5 AS VARCHAR) AS instrument, max_by(CAST(round(o_totalprice * 100) AS BIGINT) / 100000.0::DOUBLE, epoch_us(o_orderdate)::HUGEINT * 10000000000 + o_orderkey) AS price
  FROM orders GROUP BY 1),
 dims AS (SELECT 'i' || CAST(n_nationkey AS VARCHAR) AS instrument, n_name AS symbol FROM nation)"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order price per instrument."""
    o = load(spark, sf_dir, "orders").withColumn("instrument", F.concat(F.lit("i"), (F.col("o_custkey") % 5).cast("string")))
    priced = o.select("instrument", "o_orderdate", "o_orderkey",
        (F.round(F.col("o_totalprice") * 100).cast("decimal(18,0)") / 100_000).cast("decimal(18,8)").alias("price"))
    return N.latest_per(priced, ["instrument"], ["o_orderdate", "o_orderkey"]).select("instrument", "price")


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(F.concat(F.lit("i"), F.col("n_nationkey").cast("string")).alias("instrument"), F.col("n_name").alias("symbol"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as equity snapshots of one robot per customer group."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string")).alias("robot_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("cash"), (F.col("o_totalprice") * 2).alias("equity"), (F.col("o_totalprice") / 1e6).alias("return_pct"),
        ((F.col("o_orderkey") % 10) / 10).alias("exposure_ratio"))


SNAPSHOTS_SQL = """snapshots AS (
  SELECT 'r' || CAST(o_custkey % 50 AS VARCHAR) AS robot_id, o_orderdate AS ts, o_orderkey AS seq, o_totalprice AS cash, o_totalprice * 2 AS equity,
   o_totalprice / 1e6 AS return_pct, (o_orderkey % 10) / 10.0::DOUBLE AS exposure_ratio FROM orders),
 latest AS (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY robot_id ORDER BY ts DESC, seq DESC) = 1),
 rollup AS (
  SELECT sum(cash) AS cash, sum(equity) AS equity, sum(return_pct * equity) / sum(equity) AS return_pct, sum(exposure_ratio * equity) / sum(equity) AS exposure_ratio, max(ts) AS as_of FROM latest)"""
R.add("unrealized_pnl", lambda s, d: Q.open_positions(positions(s, d), marks(s, d), dims(s, d)).select("position_id", r6("unrealized_pnl")),
      f"""WITH {POSITIONS_SQL} SELECT position_id, round(CASE WHEN side = 'sell' THEN -1 ELSE 1 END * (price - entry_price) * CAST(quantity AS DOUBLE), 6) AS unrealized_pnl
 FROM positions LEFT JOIN marks USING (instrument) WHERE status = 'open'""")
R.add("pnl_unrealized", lambda s, d: Q.open_positions(positions(s, d), marks(s, d), dims(s, d)).groupBy("instrument").agg(r6(F.coalesce(F.sum("unrealized_pnl").cast("double"), F.lit(0.0)), "unrealized_pnl")),
      f"""WITH {POSITIONS_SQL} SELECT instrument, round(coalesce(sum(CASE WHEN side = 'sell' THEN -1 ELSE 1 END * (price - entry_price) * CAST(quantity AS DOUBLE)), 0), 6) AS unrealized_pnl
 FROM positions LEFT JOIN marks USING (instrument) WHERE status = 'open' GROUP BY instrument""")
R.add("q_open_positions", lambda s, d: Q.open_positions(positions(s, d), marks(s, d), dims(s, d)).select("position_id", "symbol", r6("mark"), r6("entry_notional"), r6("delta_pct")),
      f"""WITH {POSITIONS_SQL} SELECT position_id, coalesce(symbol, '?') AS symbol, round(price, 6) AS mark, round(entry_price * CAST(quantity AS DOUBLE), 6) AS entry_notional,
 round(CASE WHEN entry_price = 0 THEN 0 ELSE (price - entry_price) / entry_price * 100 END, 6) AS delta_pct
 FROM positions LEFT JOIN marks USING (instrument) LEFT JOIN dims USING (instrument) WHERE status = 'open'""")
R.add("q_prices", lambda s, d: N.lookup(marks(s, d), dims(s, d), "instrument").select("symbol", r6("price")).orderBy("symbol"),
      f"WITH {POSITIONS_SQL} SELECT symbol, round(price, 6) AS price FROM marks JOIN dims USING (instrument)")
R.add("q_exposure_now", lambda s, d: Q.exposure(Q.open_positions(positions(s, d), marks(s, d), dims(s, d))).select(F.round("exposed", 2).alias("exposed"), "open_count"),
      f"WITH {POSITIONS_SQL} SELECT round(sum(coalesce(price, entry_price) * CAST(quantity AS DOUBLE)), 2) AS exposed, count(*) AS open_count FROM positions LEFT JOIN marks USING (instrument) WHERE status = 'open'")
R.add("q_latest_per_robot", lambda s, d: Q.latest_snapshots(snapshots(s, d)).select("robot_id", us("ts"), "seq", r6("equity")),
      f"WITH {SNAPSHOTS_SQL} SELECT robot_id, epoch_us(ts) AS ts_us, seq, round(equity, 6) AS equity FROM latest")
ROLLED = ("cash", "equity", "return_pct", "exposure_ratio")
R.add("q_portfolio_rollup", lambda s, d: Q.portfolio_rollup(Q.latest_snapshots(snapshots(s, d))).select(*[r6(c) for c in ROLLED], us("as_of")),
      f"WITH {SNAPSHOTS_SQL} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in ROLLED)}, epoch_us(as_of) AS as_of_us FROM rollup")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    fall = P.max_drawdown(p.withColumn("everything", F.lit(1)), ["everything"]).select("max_drawdown")
    return Q.overview(p, marks(spark, sf_dir), snapshots(spark, sf_dir), fall).select(
        *[F.round(c, 3).alias(c) for c in ("equity", "realized_pnl_total", "realized_pnl_today", "unrealized_pnl", "max_drawdown")], "open_positions")


R.add("q_overview", overview,
      f"""WITH {POSITIONS_SQL}, {SNAPSHOTS_SQL},
 real AS (SELECT * FROM positions WHERE status = 'closed'),
 cum AS (SELECT sum(pnl_net) OVER (ORDER BY closed_at, position_id) AS c, row_number() OVER (ORDER BY closed_at, position_id) AS k FROM real),
 dd AS (SELECT max(p - c) AS v FROM (SELECT c, greatest(max(c) OVER (ORDER BY k), 0) AS p FROM cum))
 SELECT round((SELECT equity FROM rollup), 3) AS equity, round((SELECT sum(pnl_net) FROM real)::DOUBLE, 3) AS realized_pnl_total,
  round(coalesce((SELECT sum(pnl_net) FROM real WHERE date_trunc('day', closed_at) = (SELECT date_trunc('day', as_of) FROM rollup)), 0)::DOUBLE, 3) AS realized_pnl_today,
  round((SELECT sum(CASE WHEN side = 'sell' THEN -1 ELSE 1 END * (coalesce(price, entry_price) - entry_price) * CAST(quantity AS DOUBLE)) FROM positions LEFT JOIN marks USING (instrument) WHERE status = 'open'), 3) AS unrealized_pnl,
  round((SELECT v FROM dd)::DOUBLE, 3) AS max_drawdown, (SELECT count(*) FROM positions WHERE status = 'open') AS open_positions""")
R.add("q_recent_topk", lambda s, d: N.recent(snapshots(s, d), "ts", 100, "seq").select("robot_id", us("ts"), "seq"),
      f"WITH {SNAPSHOTS_SQL} SELECT robot_id, epoch_us(ts) AS ts_us, seq FROM snapshots ORDER BY ts DESC, seq DESC LIMIT 100")
R.add("q_trades", lambda s, d: N.recent(N.lookup(closed_trades(s, d).filter(~X.is_test_strategy(F.col("strategy_id"))), dims(s, d), "instrument", outer=True, missing={"symbol": "?"}),
      "closed_at", 200, "position_id").select("position_id", "symbol", us("closed_at"), r6("pnl_net")),
      f"WITH {POSITIONS_SQL} SELECT position_id, coalesce(symbol, '?') AS symbol, epoch_us(closed_at) AS closed_at_us, round(CAST(pnl_net AS DOUBLE), 6) AS pnl_net FROM trades LEFT JOIN dims USING (instrument) ORDER BY closed_at DESC, position_id DESC LIMIT 200")
R.add("q_status_filters", lambda s, d: positions(s, d).groupBy("status", "strategy_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("closed_at")).alias("last_us")).orderBy("status", "strategy_id"),
      f"WITH {POSITIONS_SQL} SELECT status, strategy_id, count(*) AS n, max(epoch_us(closed_at)) AS last_us FROM positions GROUP BY ALL")
R.add("q_cumulative_pnl", lambda s, d: Q.cumulative_pnl(closed_trades(s, d), ["strategy_id"]).select("strategy_id", "position_id", r6("cumulative_pnl")),
      f"WITH {TRADES_SQL} SELECT strategy_id, position_id, round(CAST(sum(pnl_net) OVER (PARTITION BY strategy_id ORDER BY closed_at, position_id) AS DOUBLE), 6) AS cumulative_pnl FROM trades")
R.add("q_candidate_ranking", lambda s, d: P.performance(closed_trades(s, d), ["instrument", "strategy_id"]).select("instrument", "strategy_id", "total_trades", r6("net_pnl")).orderBy(F.desc("net_pnl")),
      f"WITH {TRADES_SQL} SELECT instrument, strategy_id, count(*) AS total_trades, round(CAST(sum(pnl_net) AS DOUBLE), 6) AS net_pnl FROM trades GROUP BY ALL")
R.add("q_relative_bar", lambda s, d: Q.relative_bar(P.performance(closed_trades(s, d))).select("strategy_id", r6("bar")),
      f"WITH {TRADES_SQL}, n AS (SELECT strategy_id, CAST(sum(pnl_net) AS DOUBLE) AS v FROM trades GROUP BY ALL) SELECT strategy_id, round(abs(v) / greatest(1, (SELECT max(abs(v)) FROM n)), 6) AS bar FROM n")
R.add("trades_from_positions", lambda s, d: positions(s, d).filter("status = 'closed'").select("position_id", "strategy_id", "side", r6("entry_price"), r6("pnl_net"), r6("fees_paid")),
      f"WITH {POSITIONS_SQL} SELECT position_id, strategy_id, side, round(entry_price, 6) AS entry_price, round(CAST(pnl_net AS DOUBLE), 6) AS pnl_net, round(CAST(fees_paid AS DOUBLE), 6) AS fees_paid FROM positions WHERE status = 'closed'")


# --- decisions and joins ----------------------------------------------------------------------
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("o_orderpriority"))
    trigger = F.when(F.col("o_orderstatus") == "F", "signal").when(F.col("o_orderstatus") == "O", "stop_loss").otherwise("strategy_switch")
    approved = F.col("o_totalprice") > 50_000
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("i"), (F.col("o_custkey") % 5).cast("string")).alias("instrument"),
        F.concat(F.lit("desk::"), kind).alias("strategy_id"), trigger.alias("trigger"), approved.alias("approved"),
        F.when(~approved, "below_minimum").alias("reason"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("signal_id"), F.when(approved, F.col("o_orderkey")).alias("order_id"),
        F.when(F.col("o_custkey") % 2 == 0, "long").otherwise("short").alias("direction"), (F.col("o_custkey") % 100 / 100).alias("confidence"))


DECISIONS_SQL = f"""decisions AS (
  SELECT o_orderkey AS id, o_orderdate AS created_at, 'i' || CAST(o_custkey % 5 AS VARCHAR) AS instrument, 'desk::' || {KIND_SQL} AS strategy_id,
   CASE o_orderstatus WHEN 'F' THEN 'signal' WHEN 'O' THEN 'stop_loss' ELSE 'strategy_switch' END AS trigger, o_totalprice > 50000 AS approved,
   CASE WHEN NOT o_totalprice > 50000 THEN 'below_minimum' END AS reason, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS signal_id,
   CASE WHEN o_totalprice > 50000 THEN o_orderkey END AS order_id, CASE WHEN o_custkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction, (o_custkey % 100) / 100.0::DOUBLE AS confidence FROM orders)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = decisions(spark, sf_dir)
    signals = dec.filter("signal_id IS NOT NULL").select("signal_id", F.col("direction").alias("signal_direction"))
    placed = dec.filter("order_id IS NOT NULL").select("order_id", F.lit("filled").alias("order_status"))
    fills = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_extendedprice").alias("fill_price"))
    trades = closed_trades(spark, sf_dir).select(F.col("position_id").alias("order_id"), "pnl_net")
    base = dec.drop("direction", "confidence")
    return Q.timeline(base, dims(spark, sf_dir), signals, placed, fills, trades, 500).select(
        "id", us("created_at"), "symbol", "trigger", "approved", "signal_direction", "order_status", r6("fill_price"), r6("pnl_net"))


R.add("q_timeline", timeline,
      f"""WITH {POSITIONS_SQL}, {DECISIONS_SQL}, fills AS (SELECT l_orderkey, max(l_extendedprice) AS fill_price FROM lineitem GROUP BY 1)
 SELECT d.id, epoch_us(created_at) AS created_at_us, symbol, trigger, approved, CASE WHEN signal_id IS NOT NULL THEN direction END AS signal_direction,
  CASE WHEN order_id IS NOT NULL THEN 'filled' END AS order_status, round(fill_price, 6) AS fill_price, round(CAST(pnl_net AS DOUBLE), 6) AS pnl_net
 FROM decisions d JOIN dims USING (instrument) LEFT JOIN fills ON l_orderkey = order_id LEFT JOIN trades ON position_id = order_id
 ORDER BY created_at DESC, d.id DESC LIMIT 500""")
R.add("q_trade_context", lambda s, d: Q.trade_context(closed_trades(s, d), decisions(s, d)).select("position_id", "exit_trigger", "exit_reason", "entry_direction", r6("entry_confidence")),
      f"""WITH {TRADES_SQL}, {DECISIONS_SQL},
 ex AS (SELECT strategy_id, created_at, min_by(trigger, id) AS t FROM decisions WHERE approved AND (trigger IN ('strategy_switch', 'stop_loss') OR direction = 'short') GROUP BY ALL),
 en AS (SELECT strategy_id, created_at, min_by(confidence, id) AS c FROM decisions WHERE approved AND trigger = 'signal' AND direction = 'long' GROUP BY ALL)
 SELECT position_id, ex.t AS exit_trigger, CAST(NULL AS VARCHAR) AS exit_reason, CASE WHEN en.c IS NOT NULL THEN 'long' END AS entry_direction, round(en.c, 6) AS entry_confidence
 FROM trades t LEFT JOIN ex ON ex.strategy_id = t.strategy_id AND ex.created_at = t.closed_at LEFT JOIN en ON en.strategy_id = t.strategy_id AND en.created_at = t.opened_at""")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected decisions stand for evaluations of their instrument."""
    return decisions(spark, sf_dir).filter(~F.col("approved")).select(
        "instrument", F.col("created_at").alias("evaluated_at"), F.col("strategy_id").alias("selected"), F.col("trigger").alias("regime"), F.col("id").alias("evaluation_id"))


def switch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).filter("trigger = 'strategy_switch' AND approved AND direction = 'long'").select(
        "instrument", F.col("created_at").alias("switched_at"), F.col("strategy_id").alias("selected"), F.col("direction").alias("previous"), F.col("id").alias("switch_id"))


ASOF_SQL = f"""{TRADES_SQL}, {DECISIONS_SQL},
 judged AS (
  SELECT position_id, max_by(struct_pack(e := created_at, s := d.strategy_id, r := trigger), epoch_us(created_at)::HUGEINT * 10000000000 + id) AS j
  FROM trades t JOIN decisions d ON d.instrument = t.instrument AND NOT approved AND created_at <= opened_at GROUP BY 1),
 switched AS (
  SELECT position_id, max_by(struct_pack(a := created_at, s := d.strategy_id), epoch_us(created_at)::HUGEINT * 10000000000 + id) AS w
  FROM trades t JOIN decisions d ON d.instrument = t.instrument AND trigger = 'strategy_switch' AND approved AND direction = 'long'
   AND created_at >= opened_at - INTERVAL 1 SECOND AND created_at <= closed_at + INTERVAL 1 SECOND GROUP BY 1)"""
R.add("asof_join", lambda s, d: as_of(closed_trades(s, d), judgements(s, d), ["instrument"], "opened_at", "evaluated_at", ["evaluated_at", "selected"], ["evaluation_id"]).select("position_id", us("evaluated_at"), "selected"),
      f"WITH {ASOF_SQL} SELECT t.position_id, epoch_us(j.e) AS evaluated_at_us, j.s AS selected FROM trades t LEFT JOIN judged USING (position_id)")
R.add("interval_join", lambda s, d: N.interval_latest(closed_trades(s, d), switch_rows(s, d), ["instrument"], "opened_at", "closed_at", "switched_at", ["switched_at", "selected"], tie=["switch_id"]).select("position_id", us("switched_at"), "selected"),
      f"WITH {ASOF_SQL} SELECT t.position_id, epoch_us(w.a) AS switched_at_us, w.s AS selected FROM trades t LEFT JOIN switched USING (position_id)")
R.add("q_trade_export", lambda s, d: Q.trade_export(closed_trades(s, d), judgements(s, d), switch_rows(s, d), ["instrument"]).select(
      "position_id", us("judge_evaluated_at"), "judge_selected", "judge_regime", us("switch_switched_at"), "switch_selected", r6("pnl_net")),
      f"""WITH {ASOF_SQL} SELECT t.position_id, epoch_us(j.e) AS judge_evaluated_at_us, j.s AS judge_selected, j.r AS judge_regime, epoch_us(w.a) AS switch_switched_at_us, w.s AS switch_selected,
 round(CAST(pnl_net AS DOUBLE), 6) AS pnl_net FROM trades t LEFT JOIN judged USING (position_id) LEFT JOIN switched USING (position_id)""")


def trade_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trades as the trade file, written as CSV and read back; summaries hold quotes, commas and a line break. One robot
    an instrument, on hourly bars; prices, confidence and exits come from the numbers of the orders."""
    n = F.col("position_id")
    t = closed_trades(spark, sf_dir).withColumns({
        "entry_confidence": (n % 100 / 100).cast("decimal(4,2)"), "entry_price": (n % 1000 + 100).cast("decimal(38,8)"), "exit_price": (n % 1000 + 101).cast("decimal(38,8)"),
        "exit_trigger": F.when(n % 3 == 0, "stop_loss").when(n % 3 == 1, "signal"), "exit_reason": F.concat(F.lit("rule "), (n % 7).cast("string"))})
    e = judgements(spark, sf_dir).withColumns({
        "regime_strength": (F.col("evaluation_id") % 10 / 10).cast("decimal(2,1)"), "regime_summary": F.concat("regime", F.lit(" of\n"), "instrument"),
        "selection_summary": F.concat(F.lit('"'), "selected", F.lit('", chosen'))})
    robot = t.select("instrument").distinct().select(F.concat(F.lit("r-"), "instrument").alias("robot_id"), F.concat(F.lit("desk, "), "instrument").alias("robot_name"), "instrument", F.lit("1h").alias("timeframe"))
    out = Q.trade_file(Q.trade_export(t, e, switch_rows(spark, sf_dir).withColumn("reason", F.lit("better_score")), ["instrument"]), robot)
    path = scratch_path(spark, "trade-file")
    K.write_csv(out, path)
    return spark.read.csv(path, header=True, schema=out.schema, quote='"', escape='"', multiLine=True)


AMOUNTS = ("quantity", "entry_price", "exit_price", "pnl_gross", "fees_paid", "spread_paid", "slippage_paid", "pnl_net", "entry_confidence", "regime_strength")
ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"
R.add("sink_trade_file", lambda s, d: trade_file(s, d).select(*[r6(c) if c in AMOUNTS else c for c in Q.TRADE_FILE]),
      f"""WITH {ASOF_SQL}, t AS (
  SELECT *, position_id % 100 / 100.0 AS entry_confidence, position_id % 1000 + 100 AS entry_price, position_id % 1000 + 101 AS exit_price, date_diff('minute', opened_at, closed_at) AS minutes FROM trades)
 SELECT position_id AS trade_id, 'r-' || t.instrument AS robot_id, 'desk, ' || t.instrument AS robot_name, t.instrument AS symbol, '1h' AS timeframe, t.strategy_id, split_part(t.strategy_id, '::', 2) AS strategy, 'long' AS direction,
  {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in AMOUNTS[:9])}, strftime(opened_at, {ISO}) AS opened_at, strftime(closed_at, {ISO}) AS closed_at,
  (minutes // 60) || 'h ' || (minutes % 60) || 'm' AS duration, CASE position_id % 3 WHEN 0 THEN 'stop_loss' WHEN 1 THEN 'signal' END AS exit_trigger, 'rule ' || (position_id % 7) AS exit_reason,
  j.r AS regime_at_entry, round(CAST(d.id % 10 / 10.0 AS DOUBLE), 6) AS regime_strength, j.r || ' of' || chr(10) || t.instrument AS regime_summary, '"' || j.s || '", chosen' AS selection_summary,
  regexp_replace(regexp_replace(j.s, '^.*::', ''), '@.*$', '') AS judge_selected_strategy, strftime(j.e, {ISO}) AS judge_evaluated_at,
  CASE WHEN w IS NOT NULL THEN 'long > ' || regexp_replace(regexp_replace(w.s, '^.*::', ''), '@.*$', '') END AS related_switch, CASE WHEN w IS NOT NULL THEN 'better_score' END AS related_switch_reason, strftime(w.a, {ISO}) AS related_switch_at
 FROM t LEFT JOIN (SELECT position_id, j, i AS id FROM judged JOIN (SELECT position_id, max_by(id, epoch_us(created_at)::HUGEINT * 10000000000 + id) AS i
  FROM trades t JOIN decisions d ON d.instrument = t.instrument AND NOT approved AND created_at <= opened_at GROUP BY 1) USING (position_id)) d USING (position_id) LEFT JOIN switched USING (position_id)""")
R.add("q_judge_timeline", lambda s, d: Q.judge_timeline(judgements(s, d).select(F.col("evaluated_at").alias("at"), F.col("evaluation_id").alias("id")), switch_rows(s, d).select(F.col("switched_at").alias("at"), F.col("switch_id").alias("id"))).select(us("at"), "kind", "id"),
      f"""WITH {DECISIONS_SQL}, s AS (SELECT created_at, id FROM decisions WHERE trigger = 'strategy_switch' AND approved AND direction = 'long' ORDER BY created_at DESC, id DESC LIMIT 20),
 e AS (SELECT created_at, id FROM decisions WHERE NOT approved ORDER BY created_at DESC, id DESC LIMIT 24)
 SELECT epoch_us(created_at) AS at_us, kind, id FROM (SELECT *, 'switch' AS kind FROM s UNION ALL SELECT *, 'evaluation' FROM e) ORDER BY created_at DESC, kind, id DESC LIMIT 36""")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation in both payload versions."""
    v2 = Q.encode_evaluations(T.candidates(spark, sf_dir), ["context", "as_of"])
    v2 = v2.withColumn("evaluation_id", F.concat_ws("@", "context", F.unix_micros("as_of").cast("string")))
    v1 = v2.withColumn("payload", F.get_json_object("payload", "$.decisions"))
    return v2.unionByName(v1)


R.add("encode_evaluation", lambda s, d: Q.decode_evaluations(payloads(s, d)).select("evaluation_id", F.col("payload_version").cast("long").alias("version"), F.size("decisions").cast("long").alias("n"), "regime"),
      f"""WITH RECURSIVE {T.CANDIDATES_SQL}, c AS (SELECT context || '@' || CAST(epoch_us(as_of) AS VARCHAR) AS evaluation_id, count(*) AS n, any_value(regime) AS regime FROM candidates GROUP BY ALL)
 SELECT evaluation_id, 2::BIGINT AS version, n, regime FROM c UNION ALL SELECT evaluation_id, 1::BIGINT, n, NULL FROM c""")
R.add("decode_evaluation", lambda s, d: Q.decode_evaluations(payloads(s, d)).groupBy("payload_version", F.coalesce("regime", F.lit("unknown")).alias("regime")).agg(
      F.count(F.lit(1)).alias("evaluations"), F.sum(F.size("decisions")).alias("decisions")).withColumn("payload_version", F.col("payload_version").cast("long")),
      f"""WITH RECURSIVE {T.CANDIDATES_SQL}, c AS (SELECT context, as_of, any_value(regime) AS regime, count(*) AS n FROM candidates GROUP BY ALL)
 SELECT 2::BIGINT AS payload_version, regime, count(*) AS evaluations, CAST(sum(n) AS BIGINT) AS decisions FROM c GROUP BY regime UNION ALL SELECT 1, 'unknown', count(*), CAST(sum(n) AS BIGINT) FROM c""")
R.add("q_decision_rows", lambda s, d: Q.decision_rows(payloads(s, d)).select("evaluation_id", F.col("payload_version").cast("long").alias("version"), "strategy_id", "state", "reason", "trades"),
      f"""WITH RECURSIVE {T.CANDIDATES_SQL}, c AS (SELECT context || '@' || CAST(epoch_us(as_of) AS VARCHAR) AS evaluation_id, strategy_id, state, reason, trades FROM candidates)
 SELECT evaluation_id, v AS version, strategy_id, state, reason, trades FROM c CROSS JOIN (VALUES (1::BIGINT), (2::BIGINT)) x(v)""")


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as robots; candidate kinds of robot n trade as 'n::kind'."""
    s = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    r = s.select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("robot_id"), F.col("n_name").alias("symbol"), F.lit("1h").alias("timeframe"),
                 F.array(F.lit("momentum"), F.lit("ema_crossover")).alias("candidate_kinds"), F.abs("s_acctbal").alias("paper_capital"),
                 F.when(F.col("s_acctbal") > 0, "running").otherwise("stopped").alias("status"))
    p = positions(spark, sf_dir)
    own = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position_id"), F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string")).alias("robot"))
    p = p.join(own, "position_id").withColumn("strategy_id", X.instance_id(F.col("robot"), X.strategy_kind(F.col("strategy_id"))))
    active = N.latest_per(p.select(F.col("robot").alias("robot_id"), F.col("strategy_id").alias("selected"), "opened_at", "position_id"), ["robot_id"], ["opened_at", "position_id"]).select("robot_id", "selected")
    return Q.robot_overview(r, active, snapshots(spark, sf_dir), p).select(
        "robot_id", "symbol", "status", "selected", r6("equity"), "total_trades", r6("net_pnl"), r6("win_rate"), "open_count")


R.add("q_robots", robots,
      f"""WITH {POSITIONS_SQL}, {SNAPSHOTS_SQL},
 owned AS (SELECT p.*, 'r' || CAST(o_custkey % 50 AS VARCHAR) AS robot_id, split_part(strategy_id, '::', 2) AS kind FROM positions p JOIN orders ON o_orderkey = position_id),
 act AS (SELECT robot_id, max_by(kind, epoch_us(opened_at)::HUGEINT * 10000000000 + position_id) AS kind FROM owned GROUP BY 1),
 st AS (SELECT robot_id, count(*) FILTER (status = 'closed') AS n, count(*) FILTER (status = 'closed' AND pnl_net > 0) AS w, sum(pnl_net) FILTER (status = 'closed') AS net, count(*) FILTER (status = 'open') AS o
  FROM owned WHERE kind IN ('momentum', 'ema_crossover') GROUP BY 1),
 r AS (SELECT 'r' || CAST(s_suppkey AS VARCHAR) AS robot_id, n_name AS symbol, CASE WHEN s_acctbal > 0 THEN 'running' ELSE 'stopped' END AS status, abs(s_acctbal) AS paper FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT r.robot_id, symbol, status, CASE WHEN act.kind IN ('momentum', 'ema_crossover') THEN r.robot_id || '::' || act.kind END AS selected, round(coalesce(equity, paper), 6) AS equity,
  coalesce(n, 0) AS total_trades, round(coalesce(CAST(net AS DOUBLE), 0), 6) AS net_pnl, round(w::DOUBLE / nullif(n, 0), 6) AS win_rate, coalesce(o, 0) AS open_count
 FROM r LEFT JOIN act USING (robot_id) LEFT JOIN latest USING (robot_id) LEFT JOIN st USING (robot_id)""")

# --- upserts, catalogue and instances ---------------------------------------------------------
def marked_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of the tape, which share the middle third of its time, as a table and its changes."""
    t = tape(spark, sf_dir)
    ends = t.agg(F.min("ts"), F.max("ts")).first()
    third = (ends[1] - ends[0]) / 3 if ends[0] else None
    rows = t.select("instrument", "price", "ts", F.struct("ts", "trade_id").alias("version"))
    parts = [rows, rows] if third is None else [rows.filter(F.col("ts") < F.lit(ends[0] + 2 * third)), rows.filter(F.col("ts") >= F.lit(ends[0] + third))]
    return N.upsert(*[p.drop("ts") for p in parts], ["instrument"], "version").select("instrument", r6("price"))


R.add("keyed_upsert", marked_twice,
      f"WITH {TAPE_SQL} SELECT instrument, round(CAST(max_by(price, epoch_us(ts)::HUGEINT * 1000000000 + trade_id) AS DOUBLE), 6) AS price FROM tape GROUP BY instrument")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_name").alias("symbol"), F.concat(F.lit("id-"), F.col("c_custkey").cast("string")).alias("id"), "c_acctbal", "c_nationkey")
    old = c.filter("c_nationkey < 15").drop("c_nationkey")
    new = c.filter("c_nationkey >= 10").withColumns({"id": F.concat(F.lit("new-"), "id"), "c_acctbal": F.col("c_acctbal") + 1}).drop("c_nationkey")
    return N.stable_upsert(old, new, ["symbol"], "id").select("symbol", "id", r6("c_acctbal", "tick"))


R.add("stable_dim_upsert", upserted,
      """SELECT c_name AS symbol, CASE WHEN c_nationkey < 15 THEN '' ELSE 'new-' END || 'id-' || CAST(c_custkey AS VARCHAR) AS id,
 round(CASE WHEN c_nationkey >= 10 THEN c_acctbal + 1 ELSE c_acctbal END, 6) AS tick FROM customer""")


def instances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One instance per supplier, bound to its nation and to a region name nobody trades."""
    s = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    i = s.select(F.col("s_name").alias("id"), F.when(F.col("s_acctbal") > 5000, "momentum").otherwise("mean_reversion").alias("kind"), F.array("n_name", "r_name").alias("symbols"))
    return i, load(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"))


def instance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, unmatched, repeated = S.expand_instances(*instances(spark, sf_dir))
    return matched.select("id", "symbol", F.lit("matched").alias("outcome")).unionByName(unmatched.select("id", "symbol", F.lit("skipped").alias("outcome"))).unionByName(
        repeated.select("id", F.lit("").alias("symbol"), F.lit("duplicate").alias("outcome")))


R.add("strat_instances", instance_rows,
      """SELECT s_name AS id, n_name AS symbol, 'matched' AS outcome FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT s_name, r_name, 'skipped' FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
R.add("strategies_for_instrument", lambda s, d: S.strategies_for_instrument(S.expand_instances(*instances(s, d))[0]),
      "SELECT DISTINCT n_name AS symbol, s_name AS strategy_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")


def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades as kind-level rows fanned out to the instances allowed to see them."""
    i, _ = instances(spark, sf_dir)
    owners = i.select("id", "kind", F.element_at("symbols", 1).alias("symbol"))
    symbol = F.concat(F.lit("NATION_"), (F.col("position_id") % 25).cast("string"))
    rows = closed_trades(spark, sf_dir).select("position_id", F.substring_index("strategy_id", "::", -1).alias("strategy_id"), symbol.alias("instrument"))
    allowed = load(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_name").alias("id"))
    return S.dispatch(rows, owners, allowed).select("position_id", "strategy_id")


R.add("dispatch_ids", dispatched,
      f"""WITH {TRADES_SQL}, o AS (SELECT s_name AS id, CASE WHEN s_acctbal > 5000 THEN 'momentum' ELSE 'mean_reversion' END AS kind, n_name AS symbol FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0)
 SELECT position_id, id AS strategy_id FROM trades JOIN o ON o.kind = split_part(strategy_id, '::', 2) AND o.symbol = 'NATION_' || CAST(position_id % 25 AS VARCHAR)""")
