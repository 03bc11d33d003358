"""Costs, sizes and limits of orders as columns, and views over given positions. Running accounts are in ``accounts``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.money import execution_price, floor_to_lot, money, notional, round_to_tick
from tickloom.operators.series import framed


@dataclass(frozen=True)
class RiskConfig:
    """Limits and costs of the standard sweep."""

    initial_cash: float = 100_000.0
    order_notional: float = 1_000.0
    max_position_notional: float = 2_000.0
    max_total_exposure: float = 10_000.0
    max_open_positions: int = 5
    stop_loss: float | None = 0.05
    take_profit: float | None = 0.10
    max_daily_loss: float = 2_000.0
    taker_fee: float = 0.001
    spread_bps: float = 2.0
    slippage_bps: float = 3.0
    fill: str = "next_open"


def exit_reason(side: Column, entry: Column, mark: Column, config: RiskConfig = RiskConfig()) -> Column:
    """Stop loss first, then take profit, on P&L relative to entry."""
    gain = F.when(side == "sell", money(entry) - money(mark)).otherwise(money(mark) - money(entry))
    stop = F.lit(Decimal(str(config.stop_loss or 0))).cast("decimal(10,8)")
    take = F.lit(Decimal(str(config.take_profit or 0))).cast("decimal(10,8)")
    out = F.when(F.lit(config.stop_loss is not None) & (gain <= -stop * money(entry)), "stop_loss")
    return out.when(F.lit(config.take_profit is not None) & (gain >= take * money(entry)), "take_profit")


def exit_orders(positions_: DataFrame, marks: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Market orders of the opposite side for open positions past a limit."""
    reason = exit_reason(F.col("side"), F.col("entry_price"), F.col("mark"), config)
    return (
        positions_.join(marks, "instrument")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .withColumns({"order_side": F.when(F.col("side") == "buy", "sell").otherwise("buy"), "order_type": F.lit("market")})
    )


def sized(df: DataFrame, price: str = "close", config: RiskConfig = RiskConfig()) -> DataFrame:
    """Append ``quantity`` and ``size_reason``: the checks of an entry that need no portfolio."""
    wanted = F.lit(Decimal(str(min(config.order_notional, config.max_position_notional)))).cast("decimal(18,8)")
    rounded = round_to_tick(F.col(price), F.col("tick"))
    quantity = floor_to_lot(money(wanted / F.nullif(rounded, F.lit(0).cast("decimal(18,8)"))), F.col("lot"))
    df = df.withColumns({"_px": rounded, "quantity": quantity})
    value = notional(F.col("_px"), F.col("quantity"))
    small = F.col("min_notional")
    reason = (
        F.when(wanted <= 0, "position_size_exceeded")
        .when((wanted < small) | (F.col("_px") <= 0), "below_exchange_minimum")
        .when((F.col("quantity") <= 0) | (F.col("quantity") < F.col("min_quantity")) | (value < small), "below_exchange_minimum")
        .when(value > F.lit(Decimal(str(config.max_position_notional))), "position_size_exceeded")
    )
    return df.withColumns({"order_value": value, "size_reason": reason}).drop("_px")


def order_rejects(orders: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Append ``reject`` for orders a broker cannot fill, first failure first.

    ``open_side`` is the side of the position already held, or NULL.
    """
    quantity = floor_to_lot(F.col("quantity"), F.col("lot"))
    price = execution_price(F.col("side"), F.col("reference_price"), F.col("tick"), config.spread_bps, config.slippage_bps)
    reject = (
        F.when(F.col("order_type") != "market", "unsupported_order_type")
        .when(quantity <= 0, "invalid_quantity")
        .when(price <= 0, "invalid_execution_price")
        .when(F.col("open_side").isNull() & (F.col("side") == "sell"), "naked_short_not_supported")
        .when(F.col("open_side") == F.col("side"), "unexpected_same_side_order")
    )
    return orders.withColumns({"execution_price": price, "reject": reject})


def next_bar_fills(decided: DataFrame, keys: Sequence[str] = ("instrument", "timeframe"), layout: str = "blocks") -> DataFrame:
    """Append the open and open time of the next bar; NULL on the last one, whose orders are dropped."""
    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumns({"fill_price": F.lead("open").over(w), "fill_time": F.lead("open_time").over(w)})

    return framed(decided, keys, ["close_time"], build, ahead=1, layout=layout)


def ledger_rows(candles: DataFrame, candidates: DataFrame, instruments: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """One row per bar and strategy: the signal, its order size and execution prices.

    ``candidates`` come from ``operators.signals``; ``instruments`` carry tick, lot and minima.
    """
    bars = candles.select("instrument", "timeframe", "open_time", "close_time", "open", "close")
    wide = candidates.withColumnRenamed("ts", "close_time").drop("metadata", "confidence").join(bars, ["instrument", "timeframe", "close_time"])
    wide = sized(wide.join(instruments, "instrument"), "close", config)
    reference = F.col("close") if config.fill == "close" else F.col("open")
    return wide.withColumns(
        {
            "_buy": execution_price(F.lit("buy"), reference, F.col("tick"), config.spread_bps, config.slippage_bps),
            "_sell": execution_price(F.lit("sell"), reference, F.col("tick"), config.spread_bps, config.slippage_bps),
            "_ref": money(reference),
            # Set by a strategy switch (``streaming.jobs.admit``): the position goes before anything else happens.
            "force_exit": F.lit(False),
        }
    )


# --- views over positions ---------------------------------------------------------------------
def open_views(open_positions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Open count and exposure per instrument, strategy or portfolio."""
    return open_positions.groupBy(*by).agg(F.count(F.lit(1)).alias("open_positions"), F.sum(notional(F.col("entry_price"), F.col("quantity"))).cast("double").alias("exposure"))


def realized(trades: DataFrame, keys: Sequence[str], at: Column | None = None) -> DataFrame:
    """Summed net, in total and on the UTC day of ``at`` (the latest close if not given)."""
    latest = F.max(F.to_date("closed_at")) if at is None else F.max(F.to_date(at))
    days = trades.groupBy(*keys, F.to_date("closed_at").alias("_day")).agg(F.sum("pnl_net").cast("double").alias("_net"))
    ends = trades.groupBy(*keys).agg(latest.alias("_now"))
    return days.join(ends, list(keys)).groupBy(*keys).agg(
        F.sum("_net").alias("realized_pnl"), F.coalesce(F.sum(F.when(F.col("_day") == F.col("_now"), F.col("_net"))), F.lit(0.0)).alias("realized_today")
    )


def restore_violations(positions_: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows that make a saved portfolio unusable, with the rule each breaks."""
    status = positions_.filter(~F.col("status").isin("open", "closed")).select("portfolio", F.lit("unknown_status").alias("rule"), F.col("position_id").cast("string").alias("subject"))
    half = positions_.filter("status = 'closed' AND pnl_net IS NULL").select("portfolio", F.lit("closed_without_result").alias("rule"), F.col("position_id").cast("string").alias("subject"))
    opened = positions_.filter("status = 'open'")
    twice = opened.groupBy("portfolio", "instrument", "strategy_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "portfolio", F.lit("more_than_one_open").alias("rule"), F.concat_ws("/", "instrument", "strategy_id").alias("subject"))
    counts = opened.groupBy("portfolio").agg(F.count(F.lit(1)).alias("n"))
    off = snapshots.join(counts, "portfolio", "left").filter(F.col("open_positions") != F.coalesce("n", F.lit(0))).select(
        "portfolio", F.lit("open_count_differs").alias("rule"), F.col("open_positions").cast("string").alias("subject"))
    return status.unionByName(half).unionByName(twice).unionByName(off)
