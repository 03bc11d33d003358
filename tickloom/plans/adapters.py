"""The supplied tables read as market data, once in Spark and once as the SQL the checks use."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import candles as C
from tickloom.session import pin_utc

DEC = "decimal(18,8)"

# Order priorities stand for strategy kinds.
KINDS = {
    "1-URGENT": "momentum", "2-HIGH": "mean_reversion", "3-MEDIUM": "ema_crossover",
    "4-NOT SPECIFIED": "volatility_breakout", "5-LOW": "quant_momentum",
}
KIND_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table with its times as UTC timestamps."""
    pin_utc(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def tape_layout(spark: SparkSession, sf_dir: str, *, pooled: bool = False) -> str:
    """Layout for anything derived from the tape, from a count of its one key column."""
    from tickloom.operators.series import measured_layout

    events = load(spark, sf_dir, "events")
    return measured_layout(events.select(F.lit("all").alias("k")) if pooled else events.select(F.col("event_type").alias("k")), ["k"])


def raw_tape(spark: SparkSession, sf_dir: str, *, pooled: bool = False) -> DataFrame:
    """events as trades, whatever their price: one instrument per event type, or all in one."""
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").select(
        (F.lit("all") if pooled else F.col("event_type")).alias("instrument"),
        "ts",
        F.col("event_id").alias("trade_id"),
        F.col("value").cast(DEC).alias("price"),
        (k + 1).cast(DEC).alias("quantity"),
        F.col("event_type").isin("click", "purchase", "view").alias("is_buy"),
    )


def tape_rules() -> dict[str, Column]:
    """What a trade has to keep; the query ``tape_quarantine`` counts those that do not."""
    return {"price": F.col("price") > 0, "quantity": F.col("quantity") > 0, "ts": F.col("ts").isNotNull()}


def tape(spark: SparkSession, sf_dir: str, *, pooled: bool = False) -> DataFrame:
    """The events that are trades by the market rules."""
    return raw_tape(spark, sf_dir, pooled=pooled).filter(reduce(and_, tape_rules().values()))


TAPE_SQL = """tape AS (
  SELECT event_type AS instrument, ts, event_id AS trade_id, CAST(value AS DECIMAL(18,8)) AS price,
         CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS DECIMAL(18,8)) AS quantity,
         event_type IN ('click', 'purchase', 'view') AS is_buy
  FROM events WHERE value > 0 AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0 AND ts IS NOT NULL)"""


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h", *, pooled: bool = False) -> DataFrame:
    return C.candles_from_trades(tape(spark, sf_dir, pooled=pooled), timeframe)


def bars_sql(timeframe: str = "1h", *, pooled: bool = False) -> str:
    """CTEs ending in ``bars``; prices as DOUBLE ``*_d`` and exact columns beside them."""
    s = C.timeframe_seconds(timeframe)
    key = "'all'" if pooled else "instrument"
    return f"""{TAPE_SQL},
 keyed AS (SELECT {key} AS instrument, * EXCLUDE (instrument), (epoch_us(ts) // {s}000000) * {s} AS open_s FROM tape),
 bars AS (
  SELECT instrument, '{timeframe}' AS timeframe, open_s, open_s + {s} AS close_s,
         CAST(min_by(price, (epoch_us(ts)::HUGEINT * 1000000000 + trade_id)) AS DOUBLE) AS open,
         CAST(max(price) AS DOUBLE) AS high, CAST(min(price) AS DOUBLE) AS low,
         CAST(max_by(price, (epoch_us(ts)::HUGEINT * 1000000000 + trade_id)) AS DOUBLE) AS close,
         CAST(sum(quantity) AS DOUBLE) AS volume,
         row_number() OVER (PARTITION BY instrument ORDER BY open_s) AS rn
  FROM keyed GROUP BY instrument, open_s)"""


def us(column: str, name: str | None = None) -> Column:
    """Epoch microseconds, the same number in every engine."""
    return F.unix_micros(F.col(column)).alias(name or f"{column}_us")


class Columns:
    """A list of output columns, made when it is read: importing a module needs no session.

    A name ending in ``_us`` stands for a time in epoch microseconds.
    """

    def __init__(self, *names: str) -> None:
        self.names = names

    def __iter__(self):
        for name in self.names:
            yield us(name.removesuffix("_us")) if name.endswith("_us") else F.col(name)


def r6(column: str | Column, name: str | None = None) -> Column:
    """Six-decimal double for comparison, without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c.cast("double"), 6) + F.lit(0.0)
    return out.alias(name or column) if (name or isinstance(column, str)) else out


def closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their lines as closed positions.

    Lines are summed per order first (partial aggregation), so the join moves one row per order.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    gross = cents * (5 - F.round(F.col("l_discount") * 100).cast("bigint"))
    fees = cents * F.round(F.col("l_tax") * 100).cast("bigint")

    def scaled(total: Column, unit: str) -> Column:
        return (F.sum(total).cast("decimal(18,0)") * F.lit(Decimal(unit))).cast("decimal(18,5)")

    line = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        scaled(gross, "0.0001").alias("pnl_gross"),
        scaled(fees, "0.00001").alias("fees_paid"),
        F.sum(F.col("l_quantity").cast("decimal(18,4)")).cast("decimal(18,4)").alias("quantity"),
    )
    days = 1 + F.col("o_orderkey") % 30
    return (
        load(spark, sf_dir, "orders")
        .join(line, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_orderkey").alias("position_id"),
            F.concat(F.lit("i"), (F.col("o_custkey") % 5).cast("string")).alias("instrument"),
            F.concat(F.lit("desk::"), F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("o_orderpriority"))).alias(
                "strategy_id"
            ),
            F.lit("buy").alias("side"),
            F.col("o_orderdate").alias("opened_at"),
            (F.col("o_orderdate") + F.make_dt_interval(days=days.cast("int"))).alias("closed_at"),
            F.lit("closed").alias("status"),
            "quantity",
            "pnl_gross",
            "fees_paid",
            (F.col("pnl_gross") - F.col("fees_paid")).cast("decimal(18,5)").alias("pnl_net"),
            (F.col("fees_paid") * 2).cast("decimal(18,5)").alias("spread_paid"),
            (F.col("fees_paid") * 3).cast("decimal(18,5)").alias("slippage_paid"),
        )
    )


TRADES_SQL = f"""line AS (
  SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (5 - CAST(round(l_discount * 100) AS BIGINT))) AS DECIMAL(18,0)) * 0.0001::DECIMAL(5,4) AS pnl_gross,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT)) AS DECIMAL(18,0)) * 0.00001::DECIMAL(6,5) AS fees_paid,
         sum(CAST(l_quantity AS DECIMAL(18,4))) AS quantity
  FROM lineitem GROUP BY l_orderkey),
 trades AS (
  SELECT o_orderkey AS position_id, 'i' || CAST(o_custkey % 5 AS VARCHAR) AS instrument, 'desk::' || {KIND_SQL} AS strategy_id,
         'buy' AS side, o_orderdate AS opened_at, o_orderdate + to_days(CAST(1 + o_orderkey % 30 AS INTEGER)) AS closed_at,
         quantity, pnl_gross, fees_paid, pnl_gross - fees_paid AS pnl_net,
         fees_paid * 2 AS spread_paid, fees_paid * 3 AS slippage_paid
  FROM orders JOIN line ON o_orderkey = l_orderkey)"""


INITIAL_CASH = 100_000.0


def equity(spark: SparkSession, sf_dir: str, layout: str = "blocks") -> DataFrame:
    """One equity snapshot per closed trade and instrument, on 100 000 of cash."""
    from tickloom.operators.series import running

    t = closed_trades(spark, sf_dir)
    path = running(t, ["instrument"], ["closed_at", "position_id"], {"_net": ("sum", F.col("pnl_net"))}, layout=layout)
    return path.select(
        "instrument",
        F.col("closed_at").alias("ts"),
        F.col("position_id").alias("seq"),
        (F.col("_net") + F.lit(100_000)).cast("double").alias("equity"),
        (F.col("_net").cast("double") / INITIAL_CASH).alias("return_pct"),
    )


EQUITY_SQL = f"""{TRADES_SQL},
 equity AS (
  SELECT instrument, closed_at AS ts, position_id AS seq,
   CAST(100000 + sum(pnl_net) OVER (PARTITION BY instrument ORDER BY closed_at, position_id) AS DOUBLE) AS equity FROM trades)"""


def evaluations(t: DataFrame) -> DataFrame:
    """Every (instrument, strategy) is evaluated at each month start after a trade opened."""
    months = t.select("instrument", F.date_trunc("month", "opened_at").alias("m")).distinct()
    pairs = t.select("instrument", "strategy_id").distinct()
    return months.join(pairs, "instrument").select("instrument", "strategy_id", (F.col("m") + F.make_ym_interval(F.lit(0), F.lit(1))).alias("as_of"))


EVALUATIONS_SQL = f"""{TRADES_SQL},
 evaluations AS (
  SELECT m.instrument, strategy_id, m + INTERVAL 1 MONTH AS as_of
  FROM (SELECT DISTINCT instrument, date_trunc('month', opened_at)::TIMESTAMP AS m FROM trades) m
  JOIN (SELECT DISTINCT instrument, strategy_id FROM trades) USING (instrument))"""
