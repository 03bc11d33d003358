"""Registered queries of order sizing, costs, accounts from given fills and the sweep."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import money as M
from tickloom.operators import accounts as A
from tickloom.operators import candles as C
from tickloom.operators import ledger as L
from tickloom.operators import signals as S
from tickloom.operators import sweep as W
from tickloom.operators.series import measured_layout
from tickloom.plans.adapters import TRADES_SQL, bars, bars_sql, closed_trades, load, r6, tape_layout, us
from tickloom.plans.candle_queries import frame, gated
from tickloom.plans.registry import Registry
from tickloom.plans.report_queries import INSTRUMENTS_SQL, POSITIONS_SQL, dims, instruments, marks, positions
from tickloom.plans.trade_queries import performance_sql
from tickloom.session import stable

R = Registry()
UNITS = {"tick": "0.01", "lot": "0.0001", "min_quantity": "0.0001", "min_notional": "10"}


def units(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.lit(v).cast("decimal(18,8)") for k, v in UNITS.items()})


# --- columns ------------------------------------------------------------------------------------
def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruments(spark, sf_dir).withColumns({"min_quantity": F.col("lot"), "min_notional": F.lit(995).cast("decimal(18,8)"), "close": F.col("price")})


SIZED_SQL = f"""{INSTRUMENTS_SQL},
 px AS (SELECT *, CASE WHEN 2 * (cents % tick_cents) > tick_cents OR (2 * (cents % tick_cents) = tick_cents AND (cents // tick_cents) % 2 = 1) THEN cents // tick_cents + 1 ELSE cents // tick_cents END * tick_cents AS px FROM instruments),
 sized AS (SELECT *, CAST(floor(CAST(100000000 AS HUGEINT) // px) AS BIGINT) // lot_mills * lot_mills AS qty_mills FROM px)"""
R.add("risk_size", lambda s, d: L.sized(priced(s, d)).select("id", r6("quantity"), r6("order_value")),
      f"WITH {SIZED_SQL} SELECT id, round(qty_mills / 1000.0::DOUBLE, 6) AS quantity, round(qty_mills * px / 100000.0::DOUBLE, 6) AS order_value FROM sized")
R.add("risk_entry_rules", lambda s, d: L.sized(priced(s, d)).select("id", "size_reason"),
      f"WITH {SIZED_SQL} SELECT id, CASE WHEN qty_mills <= 0 OR qty_mills < lot_mills OR qty_mills * px / 100000.0 < 995 THEN 'below_exchange_minimum' END AS size_reason FROM sized")


def costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = instruments(spark, sf_dir)
    px = {side: M.execution_price(F.lit(side), F.col("price"), F.col("tick"), 2.0, 3.0) for side in ("buy", "sell")}
    i = i.withColumns(px)
    return i.withColumns(M.execution_costs(F.col("price"), F.col("buy"), F.col("quantity"), 2.0, 3.0, 0.001))


def moved_cents(sign: str) -> str:
    """Half-even tick rounding of cents * (1 +- 5 bp) on integers: 20000 parts of a cent."""
    n, t = f"(cents::HUGEINT * (2000 {sign} 1))", "(tick_cents * 2000)"
    return f"CASE WHEN 2 * ({n} % {t}) > {t} OR (2 * ({n} % {t}) = {t} AND ({n} // {t}) % 2 = 1) THEN {n} // {t} + 1 ELSE {n} // {t} END * tick_cents"


def moved(sign: str) -> str:
    return f"round({moved_cents(sign)} / 100.0::DOUBLE, 6)"


def six(units: str, scale: int) -> str:
    """An exact number of 1e-``scale``, half up to six decimals."""
    unit = 10 ** (scale - 6)
    return f"(({units} + {unit // 2}) // {unit}) / 1000000.0::DOUBLE"


R.add("exec_price", lambda s, d: costed(s, d).select("id", r6("buy"), r6("sell")), f"WITH {INSTRUMENTS_SQL} SELECT id, {moved('+')} AS buy, {moved('-')} AS sell FROM instruments")
R.add("exec_costs", lambda s, d: costed(s, d).select("id", r6("spread_cost"), r6("slippage_cost"), r6("fee")),
      f"""WITH {INSTRUMENTS_SQL}, sizes AS (SELECT *, CAST(round(quantity * 10000) AS HUGEINT) AS n FROM instruments)
 SELECT id, {six('cents * n * 2', 10)} AS spread_cost, {six('cents * n * 3', 10)} AS slippage_cost, {six(f"({moved_cents('+')}) * n", 9)} AS fee FROM sizes""")


def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as broker requests against positions of the same customer group."""
    o = load(spark, sf_dir, "orders")
    return units(o.select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "limit").otherwise("market").alias("order_type"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), F.when(F.col("o_custkey") % 3 == 0, "buy").alias("open_side"),
        F.when(F.col("o_custkey") % 10 == 9, F.lit(0.00001)).otherwise(F.lit(1.0)).cast("decimal(18,8)").alias("quantity"), F.col("o_totalprice").cast("decimal(18,8)").alias("reference_price")))


R.add("exec_reject", lambda s, d: L.order_rejects(submitted(s, d)).select("o_orderkey", "reject"),
      """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'unsupported_order_type' WHEN o_custkey % 10 = 9 THEN 'invalid_quantity'
 WHEN o_orderstatus = 'F' AND o_custkey % 3 <> 0 THEN 'naked_short_not_supported' WHEN o_orderstatus <> 'F' AND o_custkey % 3 = 0 THEN 'unexpected_same_side_order' END AS reject FROM orders""")


def at_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exit_orders(positions(spark, sf_dir).filter("status = 'open'"), marks(spark, sf_dir).withColumnRenamed("price", "mark"))


LIMITS_SQL = f"""{POSITIONS_SQL}, gains AS (SELECT position_id, side, CASE WHEN side = 'sell' THEN entry_price - price ELSE price - entry_price END / entry_price AS g
 FROM positions JOIN marks USING (instrument) WHERE status = 'open')"""
R.add("risk_exit_check", lambda s, d: at_limits(s, d).select("position_id", "reason"), f"WITH {LIMITS_SQL} SELECT position_id, CASE WHEN g <= -0.05 THEN 'stop_loss' ELSE 'take_profit' END AS reason FROM gains WHERE g <= -0.05 OR g >= 0.1")
R.add("exit_order", lambda s, d: at_limits(s, d).select("position_id", "order_side", "order_type", r6("quantity")),
      f"WITH {LIMITS_SQL} SELECT position_id, CASE WHEN g.side = 'buy' THEN 'sell' ELSE 'buy' END AS order_side, 'market' AS order_type, round(CAST(quantity AS DOUBLE), 6) AS quantity FROM gains g JOIN trades USING (position_id) WHERE g <= -0.05 OR g >= 0.1")
R.add("next_bar_fill", lambda s, d: L.next_bar_fills(bars(s, d, "1h")).select("instrument", us("close_time"), r6("fill_price"), us("fill_time")),
      f"WITH {bars_sql('1h')} SELECT instrument, close_s * 1000000 AS close_time_us, round(lead(open) OVER w, 6) AS fill_price, lead(open_s) OVER w * 1000000 AS fill_time_us FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY rn)")
R.add("ledger_views", lambda s, d: L.open_views(positions(s, d).filter("status = 'open'"), ["instrument", "strategy_id"]).select("instrument", "strategy_id", "open_positions", r6("exposure")),
      f"WITH {POSITIONS_SQL} SELECT instrument, strategy_id, count(*) AS open_positions, round(sum(entry_price * CAST(quantity AS DOUBLE)), 6) AS exposure FROM positions WHERE status = 'open' GROUP BY ALL")
R.add("pnl_realized", lambda s, d: L.realized(closed_trades(s, d), ["instrument"]).select("instrument", r6("realized_pnl"), r6("realized_today")),
      f"""WITH {TRADES_SQL}, n AS (SELECT instrument, max(date_trunc('day', closed_at)) AS today FROM trades GROUP BY 1)
 SELECT instrument, round(CAST(sum(pnl_net) AS DOUBLE), 6) AS realized_pnl, round(coalesce(CAST(sum(pnl_net) FILTER (date_trunc('day', closed_at) = today) AS DOUBLE), 0), 6) AS realized_today FROM trades JOIN n USING (instrument) GROUP BY 1""")


R.add("pnl_realized_today", lambda s, d: L.realized(closed_trades(s, d), ["strategy_id"]).select("strategy_id", r6("realized_today")),
      f"""WITH {TRADES_SQL}, n AS (SELECT strategy_id, max(date_trunc('day', closed_at)) AS today FROM trades GROUP BY 1)
 SELECT strategy_id, round(coalesce(CAST(sum(pnl_net) FILTER (date_trunc('day', closed_at) = today) AS DOUBLE), 0), 6) AS realized_today FROM trades JOIN n USING (strategy_id) GROUP BY 1""")


def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolios of one customer group each; saved open counts are those of the first half of the month."""
    p = positions(spark, sf_dir).withColumn("portfolio", F.col("instrument"))
    saved = p.filter("status = 'open'").groupBy("portfolio").agg(F.count_if(F.col("pnl_gross") > 0).alias("open_positions"))
    return L.restore_violations(p, saved).groupBy("portfolio", "rule").agg(F.count(F.lit(1)).alias("n"))


R.add("ledger_restore_check", restored,
      f"""WITH {POSITIONS_SQL}, o AS (SELECT * FROM positions WHERE status = 'open'),
 t AS (SELECT instrument, strategy_id FROM o GROUP BY ALL HAVING count(*) > 1),
 c AS (SELECT instrument, count(*) AS n, count(*) FILTER (pnl_gross > 0) AS saved FROM o GROUP BY 1)
 SELECT instrument AS portfolio, 'more_than_one_open' AS rule, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT instrument, 'open_count_differs', 1 FROM c WHERE n <> saved""")

# --- accounts from given fills --------------------------------------------------------------------
POSITION = ["portfolio", "instrument"]
LIMITS = L.RiskConfig(initial_cash=50_000.0, max_open_positions=12, max_total_exposure=40_000.0, max_daily_loss=25.0)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in time, a buy and a sell by turns; fifty portfolios share the customers."""
    cents = F.floor(F.round(F.col("o_totalprice") * 100) / 1000).cast("bigint")
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = load(spark, sf_dir, "orders").withColumn("_turn", turn)
    price = (cents.cast("decimal(18,0)") / 100).cast("decimal(18,8)")
    return o.select(
        F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("portfolio"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("instrument"),
        F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("fill_id"), F.when(F.col("_turn") % 2 == 1, "buy").otherwise("sell").alias("side"),
        (1 + F.col("o_custkey") % 3).cast("decimal(18,8)").alias("quantity"), price.alias("price"), (price * (1 + F.col("o_custkey") % 3) * F.lit(Decimal("0.001"))).cast("decimal(18,8)").alias("fee"))


def fills_layout(spark: SparkSession, sf_dir: str) -> str:
    """A portfolio is the largest key of all queries on the fills."""
    return measured_layout(load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k")), ["k"])


# Money in SQL: whole numbers of 1e-5.
FILLS_SQL = """ordered AS (
  SELECT 'p' || CAST(o_custkey % 50 AS VARCHAR) AS portfolio, 'c' || CAST(o_custkey AS VARCHAR) AS instrument, o_orderdate AS t, o_orderkey AS fill_id, o_orderstatus AS status,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn, 1 + o_custkey % 3 AS q, CAST(round(o_totalprice * 100) AS BIGINT) // 1000 AS cents FROM orders),
 fills AS (SELECT *, turn % 2 = 1 AS buy, q * cents * 1000 AS value, q * cents AS fee, lag(q * cents * 1000) OVER w AS entry_value, lag(q * cents) OVER w AS entry_fee,
   lead(t) OVER w AS next_at, lead(cents) OVER w AS next_cents, lead(q * cents) OVER w AS next_fee FROM ordered WINDOW w AS (PARTITION BY instrument ORDER BY turn)),
 moves AS (SELECT *, CASE WHEN buy THEN -value - fee ELSE value - fee END AS d_cash, CASE WHEN buy THEN value ELSE -entry_value END AS d_cost, CASE WHEN buy THEN q ELSE -q END AS d_held,
   CASE WHEN buy THEN 1 ELSE -1 END AS d_open, CASE WHEN buy THEN 0 ELSE value - entry_value - fee - entry_fee END AS d_net FROM fills)"""
R.add("ledger_open", lambda s, d: A.opened(fills(s, d), POSITION).select("portfolio", "instrument", us("at"), r6("quantity"), r6("entry_price")),
      f"WITH {FILLS_SQL} SELECT portfolio, instrument, epoch_us(t) AS at_us, q::DOUBLE AS quantity, cents / 100.0::DOUBLE AS entry_price FROM fills WHERE buy")
R.add("ledger_close", lambda s, d: A.closed(fills(s, d), POSITION, fills_layout(s, d)).select("position_id", "portfolio", us("opened_at"), us("closed_at"), r6("quantity"), r6("exit_price"), r6("pnl_gross"), r6("fees_paid"), r6("pnl_net")),
      f"""WITH {FILLS_SQL} SELECT fill_id AS position_id, portfolio, epoch_us(t) AS opened_at_us, epoch_us(next_at) AS closed_at_us, q::DOUBLE AS quantity, next_cents / 100.0::DOUBLE AS exit_price,
 q * (next_cents - cents) / 100.0::DOUBLE AS pnl_gross, (fee + next_fee) / 100000.0::DOUBLE AS fees_paid, (q * (next_cents - cents) * 1000 - fee - next_fee) / 100000.0::DOUBLE AS pnl_net
 FROM fills WHERE buy AND next_at IS NOT NULL""")
PATH = "PARTITION BY portfolio ORDER BY t, fill_id"
R.add("equity_curve", lambda s, d: A.account_path(fills(s, d), ["portfolio"], POSITION, LIMITS.initial_cash, layout=fills_layout(s, d)).select("fill_id", "portfolio", r6("cash"), r6("exposure"), "open_positions", r6("realized_pnl")),
      f"""WITH {FILLS_SQL} SELECT fill_id, portfolio, (5000000000 + sum(d_cash) OVER w) / 100000.0::DOUBLE AS cash, sum(d_cost) OVER w / 100000.0::DOUBLE AS exposure, CAST(sum(d_open) OVER w AS BIGINT) AS open_positions,
 sum(d_net) OVER w / 100000.0::DOUBLE AS realized_pnl FROM moves WINDOW w AS ({PATH})""")


def entry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.entry_limits(fills(spark, sf_dir), ["portfolio"], POSITION, LIMITS, fills_layout(spark, sf_dir))


R.add("risk_exposure_state", lambda s, d: entry_states(s, d).select("fill_id", r6("cash"), r6("exposure"), "open_positions", r6("realized_today"), "reason"),
      f"""WITH {FILLS_SQL}, met AS (
  SELECT *, 5000000000 + coalesce(sum(d_cash) OVER w, 0) AS cash, coalesce(sum(d_cost) OVER w, 0) AS cost, coalesce(sum(d_open) OVER w, 0) AS n,
   coalesce(sum(d_net) OVER (PARTITION BY portfolio, CAST(t AS DATE) ORDER BY t, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS today
  FROM moves WINDOW w AS ({PATH} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT fill_id, cash / 100000.0::DOUBLE AS cash, cost / 100000.0::DOUBLE AS exposure, CAST(n AS BIGINT) AS open_positions, today / 100000.0::DOUBLE AS realized_today,
  CASE WHEN n >= 12 THEN 'max_open_positions_reached' WHEN today < 0 AND -today >= 2500000 THEN 'daily_loss_limit_breached' WHEN cost + value > 4000000000 THEN 'exposure_limit_exceeded'
   WHEN cash < value THEN 'insufficient_balance' END AS reason FROM met WHERE buy""")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day after each order its customer's instrument gets a signal."""
    return load(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("portfolio"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("instrument"), "o_orderkey",
        (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(1))).alias("ts"), F.when(F.col("o_orderstatus") == "F", "short").otherwise("long").alias("direction"))


R.add("risk_route", lambda s, d: A.routed(candidates(s, d), fills(s, d), POSITION, fills_layout(s, d)).select("o_orderkey", "reason"),
      f"""WITH {FILLS_SQL}, held AS (SELECT c.fill_id, c.status, (SELECT max(f.turn) FROM fills f WHERE f.instrument = c.instrument AND f.t <= c.t + INTERVAL 1 DAY) % 2 = 1 AS held FROM fills c)
 SELECT fill_id AS o_orderkey, CASE WHEN held AND status <> 'F' THEN 'position_already_open' WHEN NOT held AND status = 'F' THEN 'short_selling_not_supported' END AS reason FROM held""")


def account_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days after each order its instrument is marked, a tenth above it."""
    f = fills(spark, sf_dir)
    return f.select(*POSITION, "fill_id", (F.col("at") + F.make_dt_interval(days=F.lit(10))).alias("ts"), (F.col("price") * F.lit(Decimal("1.1"))).cast("decimal(18,8)").alias("price"))


def sixth(ratio: str):
    """Six decimals of a double in double arithmetic, as SQL rounds it; many of these ratios are ties."""
    return (F.round(F.col(ratio) * 1e6) / 1e6).alias(ratio)


R.add("equity_point", lambda s, d: A.equity_points(fills(s, d), account_marks(s, d).withColumnRenamed("fill_id", "mark_id"), POSITION, 10_000.0, fills_layout(s, d)).select("mark_id", r6("cash"), r6("equity"), r6("unrealized_pnl"), r6("realized_pnl"), sixth("exposure_ratio"), sixth("return_pct")),
      f"""WITH {FILLS_SQL}, path AS (SELECT *, 1000000000 + sum(d_cash) OVER w AS cash, sum(d_cost) OVER w AS cost, sum(d_held) OVER w AS held, sum(d_net) OVER w AS net FROM moves WINDOW w AS (PARTITION BY instrument ORDER BY turn)),
 marked AS (SELECT m.fill_id AS mark_id, m.cents * 1100 AS mark, p.* FROM fills m JOIN path p ON p.instrument = m.instrument AND p.turn = (SELECT max(f.turn) FROM fills f WHERE f.instrument = m.instrument AND f.t <= m.t + INTERVAL 10 DAY)),
 worth AS (SELECT *, cash + held * mark AS equity FROM marked)
 SELECT mark_id, cash / 100000.0::DOUBLE AS cash, equity / 100000.0::DOUBLE AS equity, (held * mark - cost) / 100000.0::DOUBLE AS unrealized_pnl, net / 100000.0::DOUBLE AS realized_pnl,
  round(CASE WHEN equity > 0 THEN cost::DOUBLE / equity::DOUBLE ELSE 0 END, 6) AS exposure_ratio, round((equity - 1000000000) / 1000000000.0::DOUBLE, 6) AS return_pct FROM worth""")


def leaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh open position belongs to a replaced strategy, every third has an exit signal."""
    p = positions(spark, sf_dir).filter("status = 'open'").withColumns({"force_exit": F.col("position_id") % 11 == 0, "signal_exit": F.col("position_id") % 3 == 0})
    return A.exit_choice(p, marks(spark, sf_dir).withColumnRenamed("price", "mark"))


R.add("exit_precedence", lambda s, d: leaving(s, d).select("position_id", "reason"),
      f"""WITH {LIMITS_SQL}, r AS (SELECT position_id, CASE WHEN position_id % 11 = 0 THEN 'strategy_switch' WHEN g <= -0.05 THEN 'stop_loss' WHEN g >= 0.1 THEN 'take_profit' WHEN position_id % 3 = 0 THEN 'signal' END AS reason FROM gains)
 SELECT * FROM r WHERE reason IS NOT NULL""")


RET = gated(f"close / first_value(close) {frame(10)} - 1", 10)
SIGNALS_SQL = f"{bars_sql('1h')}, zs AS (SELECT *, {RET} AS x FROM bars), signals AS (SELECT *, CASE WHEN x >= 0.01 THEN 'long' WHEN x <= -0.01 THEN 'short' END AS entry FROM zs)"


def momentum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.momentum(bars(spark, sf_dir, "1h"), layout=tape_layout(spark, sf_dir))


def instances_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as instances: half follow momentum, each on the event type of its nation number."""
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    return load(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "momentum").otherwise("mean_reversion").alias("kind"), F.element_at(kinds, F.col("s_nationkey") % 5 + 1).alias("symbol"))


R.add("dispatch", lambda s, d: S.dispatch(momentum_rows(s, d), instances_of(s, d)).groupBy("strategy_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("entry") == "long").alias("longs"), F.count_if(F.col("entry") == "short").alias("shorts")),
      f"""WITH {SIGNALS_SQL}, o AS (SELECT s_name AS strategy_id, list_extract(['click', 'error', 'purchase', 'signup', 'view'], s_nationkey % 5 + 1) AS instrument FROM supplier WHERE s_suppkey % 2 = 0)
 SELECT strategy_id, count(*) AS rows, count(*) FILTER (entry = 'long') AS longs, count(*) FILTER (entry = 'short') AS shorts FROM signals JOIN o USING (instrument) GROUP BY 1""")


# --- sweep --------------------------------------------------------------------------------------
RUN = list(W.RUN)


# Orders of even number run on daily candles, the others on weekly ones.
SWEPT = ("1d", "1w")


def run_slices(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """By timeframe: what each slice of candles (of order prices) ran on, the keys of clean slices, the skipped slices."""
    prices = load(spark, sf_dir, "orders").filter("o_totalprice > 0").select(
        F.concat(F.lit("i"), (F.col("o_custkey") % 5).cast("string")).alias("instrument"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("trade_id"),
        F.col("o_totalprice").cast("decimal(18,8)").alias("price"), F.lit(1).cast("decimal(18,8)").alias("quantity"))
    found = []
    for timeframe in SWEPT:
        # A row per bar and window; three aggregates read it.
        cut = stable(W.windowed(C.candles_from_trades(prices, timeframe)))
        kept, skipped, report = W.strict(cut, timeframe, trade_layout(spark, sf_dir))
        found.append((W.run_data(cut, report), kept.select(*W.SLICE).distinct(), skipped))
    return found


def run_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable(reduce(DataFrame.unionByName, [data for data, _, _ in run_slices(spark, sf_dir)]))


def run_trades(spark: SparkSession, sf_dir: str, data: DataFrame) -> DataFrame:
    """Closed trades in every slice whose period they lie in."""
    timeframe = F.when(F.col("position_id") % 2 == 0, SWEPT[0]).otherwise(SWEPT[1])
    t = closed_trades(spark, sf_dir).withColumns({"symbol": F.col("instrument"), "timeframe": timeframe, "strategy_id": F.substring_index("strategy_id", "::", -1)})
    return W.trades_in_slices(t, data)


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of the matrix behind the strict gate: its trades, or why its slice was skipped."""
    parts = run_slices(spark, sf_dir)
    clean = reduce(DataFrame.unionByName, [kept for _, kept, _ in parts])
    skipped = reduce(DataFrame.unionByName, [bad for _, _, bad in parts])
    data = reduce(DataFrame.unionByName, [d for d, _, _ in parts]).join(clean, list(W.SLICE), "left_semi")
    trades = run_trades(spark, sf_dir, data).groupBy(*RUN).agg(F.count(F.lit(1)).alias("trades"), us_of("min", "opened_at", "first_us"), us_of("max", "closed_at", "last_us"))
    ran = W.matrix(clean).join(trades, RUN, "left").select(*RUN, F.lit(False).alias("skipped"), F.coalesce("trades", F.lit(0)).alias("trades"), "first_us", "last_us", *[F.lit(0).cast("long").alias(c) for c in FAULTS])
    none = F.lit(None).cast("long")
    left_out = W.matrix(skipped).join(skipped.select(*W.SLICE, *FAULTS), list(W.SLICE)).select(*RUN, F.lit(True).alias("skipped"), F.lit(0).cast("long").alias("trades"), none.alias("first_us"), none.alias("last_us"), *FAULTS)
    return ran.unionByName(left_out)


def us_of(which: str, column: str, name: str) -> Column:
    return F.unix_micros(getattr(F, which)(column)).alias(name)


FAULTS = ("gap_count", "total_missing", "duplicate_count", "out_of_order_count")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full report of every run, clean or not, with what it ran on."""
    data = run_data(spark, sf_dir)
    return W.experiment_reports(run_trades(spark, sf_dir, data), data, 100_000.0, layout=trade_layout(spark, sf_dir))


# Columns of a report beside its keys: as they are, to 6 decimals, and returns on a given balance to 10, which is all they have.
REPORT_COUNTS = ("candles_used", *FAULTS, "total_trades", "winners", "losers", "average_duration_s", "positive_days", "negative_days", "flat_days")
REPORT_FIGURES = ("benchmark_return", "win_rate", "gross_pnl", "net_pnl", "average_win", "average_loss", "profit_factor", "expectancy", "max_drawdown", "total_fees", "total_spread_cost",
                  "total_slippage_cost", "average_daily_return_pct", "max_drawdown_pct")
REPORT_RETURNS = ("gross_return_pct", "net_return_pct")


def report_figures(df: DataFrame, named: Mapping[str, str] = {}) -> list[Column]:
    """Columns of ``df`` to compare; ``named`` gives those with another name there."""
    at = {c: named.get(c, c) for c in (*REPORT_COUNTS, *REPORT_FIGURES, *REPORT_RETURNS)}
    return [*[F.col(at[c]).alias(at[c]) for c in REPORT_COUNTS if at[c] in df.columns], *[r6(at[c]) for c in REPORT_FIGURES if at[c] in df.columns],
            *[(F.round(at[c], 10) + F.lit(0.0)).alias(at[c]) for c in REPORT_RETURNS if at[c] in df.columns]]


WINDOWS_SQL = "(VALUES ('full', NULL), ('24m', 24), ('12m', 12), ('6m', 6), ('3m', 3)) v(span, months)"
RUNS_SQL = f"""{TRADES_SQL},
 candles AS (SELECT 'i' || CAST(o_custkey % 5 AS VARCHAR) AS symbol, timeframe, step, epoch_us(o_orderdate) // (step * 1000000) * step AS open_s,
   CAST(max_by(CAST(o_totalprice AS DECIMAL(18,8)), epoch_us(o_orderdate)::HUGEINT * 10000000000 + o_orderkey) AS DOUBLE) AS close
  FROM orders CROSS JOIN (VALUES ('1d', 86400::BIGINT), ('1w', 604800::BIGINT)) f(timeframe, step) WHERE o_totalprice > 0 GROUP BY ALL),
 stops AS (SELECT symbol, timeframe, make_timestamp(max(open_s + step) * 1000000) AS stop FROM candles GROUP BY ALL),
 cut AS (SELECT * FROM candles JOIN stops USING (symbol, timeframe) CROSS JOIN {WINDOWS_SQL} WHERE months IS NULL OR make_timestamp(open_s * 1000000) >= stop - to_months(months)),
 holes AS (SELECT *, coalesce((open_s - lag(open_s) OVER (PARTITION BY symbol, timeframe, span ORDER BY open_s)) // step - 1, 0) AS missing FROM cut),
 data AS (SELECT symbol, timeframe, span, min(open_s) * 1000000 AS period_start_us, max(open_s + step) * 1000000 AS period_end_us, count(*) AS candles_used, count(*) FILTER (missing > 0) AS gap_count,
   CAST(sum(missing) AS BIGINT) AS total_missing, 0::BIGINT AS duplicate_count, 0::BIGINT AS out_of_order_count, (max_by(close, open_s) - min_by(close, open_s)) / min_by(close, open_s) AS benchmark_return
  FROM holes GROUP BY ALL),
 runs AS (SELECT symbol, d.timeframe, span, split_part(t.strategy_id, '::', 2) AS strategy_id, t.* EXCLUDE (instrument, strategy_id) FROM trades t JOIN data d
  ON symbol = instrument AND d.timeframe = CASE WHEN position_id % 2 = 0 THEN '1d' ELSE '1w' END AND epoch_us(opened_at) >= period_start_us AND epoch_us(closed_at) <= period_end_us),
 kinds AS (SELECT * FROM (VALUES {', '.join(f"('{k}')" for k in S.CATALOG)}) b(strategy_id))"""
RUN_SQL = "symbol, timeframe, span, strategy_id"
REPORTS_SQL = f"""{RUNS_SQL}, {performance_sql(RUN_SQL, 'runs')},
 path AS (SELECT *, sum(pnl_net) OVER (PARTITION BY {RUN_SQL} ORDER BY closed_at, position_id) AS net FROM runs),
 falls AS (SELECT *, 100000 + CAST(net AS DOUBLE) AS equity, max(net) OVER (PARTITION BY {RUN_SQL} ORDER BY closed_at, position_id) AS top FROM path),
 drawn AS (SELECT {RUN_SQL}, CAST(max(greatest(top, 0) - net) AS DOUBLE) AS max_drawdown, max((100000 + CAST(top AS DOUBLE) - equity) / nullif(greatest(100000 + CAST(top AS DOUBLE), 0), 0)) AS max_drawdown_pct FROM falls GROUP BY ALL),
 ends AS (SELECT {RUN_SQL}, date_trunc('day', closed_at) AS p, max_by(equity, epoch_us(closed_at)::HUGEINT * 10000000000 + position_id) AS e FROM falls GROUP BY ALL),
 rets AS (SELECT *, coalesce((e - lag(e, 1, 100000) OVER q) / nullif(lag(e, 1, 100000) OVER q, 0), 0) AS r FROM ends WINDOW q AS (PARTITION BY {RUN_SQL} ORDER BY p)),
 days AS (SELECT {RUN_SQL}, avg(r) AS average_daily_return_pct, count(*) FILTER (r > 0) AS positive_days, count(*) FILTER (r < 0) AS negative_days, count(*) FILTER (r = 0) AS flat_days FROM rets GROUP BY ALL),
 reports AS (SELECT * REPLACE ({', '.join(f'coalesce({c}, 0) AS {c}' for c in (*REPORT_COUNTS[5:], *(c for c in REPORT_FIGURES if c not in ('benchmark_return', 'profit_factor'))))}),
   coalesce(gross_pnl, 0) / 100000 AS gross_return_pct, coalesce(net_pnl, 0) / 100000 AS net_return_pct
  FROM data CROSS JOIN kinds LEFT JOIN report USING ({RUN_SQL}) LEFT JOIN drawn USING ({RUN_SQL}) LEFT JOIN days USING ({RUN_SQL}))"""


def report_figures_sql(named: Mapping[str, str] = {}) -> str:
    shown = [(c, c) for c in REPORT_COUNTS] + [(f"round({c}, 6)", c) for c in REPORT_FIGURES] + [(f"round({c}, 10)", c) for c in REPORT_RETURNS]
    return ", ".join(f"{v} AS {named.get(c, c)}" for v, c in shown)


R.add("sweep_matrix", lambda s, d: W.matrix(W.windowed(bars(s, d, "1h")).select(*W.SLICE).distinct()),
      f"""WITH {bars_sql('1h')} SELECT DISTINCT instrument AS symbol, timeframe, w AS "window", k AS strategy_id FROM bars CROSS JOIN (VALUES ('full'), ('24m'), ('12m'), ('6m'), ('3m')) a(w)
 CROSS JOIN (VALUES {', '.join(f"('{k}')" for k in S.CATALOG)}) b(k)""")
R.add("sweep_run", swept,
      f"""WITH {RUNS_SQL}, done AS (SELECT {RUN_SQL}, count(*) AS trades, epoch_us(min(opened_at)) AS first_us, epoch_us(max(closed_at)) AS last_us FROM runs GROUP BY ALL)
 SELECT symbol, timeframe, span AS "window", strategy_id, gap_count > 0 AS skipped, CASE WHEN gap_count > 0 THEN 0 ELSE coalesce(trades, 0) END AS trades, CASE WHEN gap_count = 0 THEN first_us END AS first_us,
  CASE WHEN gap_count = 0 THEN last_us END AS last_us, {', '.join(FAULTS)} FROM data CROSS JOIN kinds LEFT JOIN done USING ({RUN_SQL})""")
R.add("experiment_report", lambda s, d: (r := reports(s, d)).select(
    *RUN, us("period_start"), us("period_end"), *report_figures(r), F.coalesce(F.size("monthly_returns"), F.lit(0)).cast("long").alias("months")),
      f"""WITH {REPORTS_SQL}, m AS (SELECT {RUN_SQL}, count(DISTINCT date_trunc('month', closed_at)) AS months FROM runs GROUP BY ALL)
 SELECT symbol, timeframe, span AS "window", strategy_id, period_start_us, period_end_us, {report_figures_sql()}, coalesce(months, 0) AS months FROM reports LEFT JOIN m USING ({RUN_SQL})""")


def trade_layout(spark: SparkSession, sf_dir: str) -> str:
    return measured_layout(load(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("k")), ["k"])


def trade_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades as experiment reports: one per instrument, year and strategy."""
    from tickloom.operators.performance import performance

    t = closed_trades(spark, sf_dir).withColumns({"symbol": F.col("instrument"), "timeframe": F.lit("1d"), "window": F.element_at(F.array(*[F.lit(w) for w in ("24m", "12m", "6m", "3m", "full")]), F.year("opened_at") % 5 + 1),
                                                  "strategy_id": F.substring_index("strategy_id", "::", -1)})
    p = performance(t, RUN)
    return p.withColumns({"initial_balance": F.lit(100_000.0), "gross_return_pct": F.col("gross_pnl") / 100_000, "net_return_pct": F.col("net_pnl") / 100_000})


DIAGNOSED_SQL = f"""{TRADES_SQL},
 runs AS (SELECT instrument AS symbol, list_extract(['24m', '12m', '6m', '3m', 'full'], CAST(year(opened_at) % 5 + 1 AS INTEGER)) AS w, split_part(strategy_id, '::', 2) AS strategy_id, count(*) AS n,
   CAST(sum(pnl_gross) AS DOUBLE) AS g, CAST(sum(pnl_net) AS DOUBLE) AS net, CAST(sum(fees_paid) * 6 AS DOUBLE) AS costs FROM trades GROUP BY ALL),
 diagnosed AS (SELECT *, CASE WHEN n < 30 THEN 'LOW_SAMPLE' WHEN g <= 0 THEN 'NO_EDGE' WHEN net <= 0 THEN 'FRICTION_LIMITED' ELSE 'NET_POSITIVE' END AS class FROM runs)"""
R.add("diag_classify", lambda s, d: W.diagnostics(trade_reports(s, d)).select("symbol", "window", "strategy_id", "class"), f'WITH {DIAGNOSED_SQL} SELECT symbol, w AS "window", strategy_id, class FROM diagnosed')
R.add("diag_row", lambda s, d: W.diagnostics(trade_reports(s, d)).select("symbol", "window", "strategy_id", r6("total_costs"), r6("costs_pct")),
      f'WITH {DIAGNOSED_SQL} SELECT symbol, w AS "window", strategy_id, round(costs, 6) AS total_costs, round(costs / 100000, 6) AS costs_pct FROM diagnosed')
R.add("diag_consistency", lambda s, d: W.consistency(W.diagnostics(trade_reports(s, d))).select("symbol", "strategy_id", F.concat_ws(",", "classes").alias("classes"), "consistent"),
      f"""WITH {DIAGNOSED_SQL} SELECT symbol, strategy_id, string_agg(w || '=' || class, ',' ORDER BY CASE w WHEN '24m' THEN 0 WHEN '12m' THEN 1 WHEN '6m' THEN 2 WHEN '3m' THEN 3 ELSE 4 END) AS classes,
 count(DISTINCT class) <= 1 AS consistent FROM diagnosed GROUP BY ALL""")
R.add("diag_pairs", lambda s, d: W.pairs(W.diagnostics(trade_reports(s, d))).select("symbol", "window", "baseline", "quant", r6("baseline_net"), r6("quant_net"), "baseline_class", "quant_class"),
      f"""WITH {DIAGNOSED_SQL} SELECT b.symbol, b.w AS "window", b.strategy_id AS baseline, q.strategy_id AS quant, round(b.net / 100000, 6) AS baseline_net, round(q.net / 100000, 6) AS quant_net, b.class AS baseline_class, q.class AS quant_class
 FROM diagnosed b JOIN (VALUES {', '.join(str(p) for p in W.PAIRS)}) p(x, y) ON p.x = b.strategy_id JOIN diagnosed q ON q.strategy_id = p.y AND q.symbol = b.symbol AND q.w = b.w""")
R.add("strat_catalog", lambda s, d: closed_trades(s, d).select(F.substring_index("strategy_id", "::", -1).alias("kind")).join(S.catalog_table(s), "kind").groupBy("kind", "category").agg(F.count(F.lit(1)).alias("trades")),
      f"WITH {TRADES_SQL} SELECT split_part(strategy_id, '::', 2) AS kind, CASE WHEN kind IN ('momentum', 'mean_reversion', 'ema_crossover') THEN 'baseline' ELSE 'quantitative' END AS category, count(*) AS trades FROM trades GROUP BY ALL")
