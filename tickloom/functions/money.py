"""Column expressions for prices, sizes and costs. Arithmetic is decimal(18,8)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.schemas import MONEY


def money(value: Column) -> Column:
    return value.cast(MONEY)


def notional(price: Column, quantity: Column) -> Column:
    return money(price) * money(quantity)


def _tick(price: Column, tick: Column) -> Column:
    zero = F.lit(0).cast(MONEY)
    return F.when(tick > 0, F.bround(price / F.nullif(tick, zero), 0) * tick).otherwise(price).cast(MONEY)


def round_to_tick(price: Column, tick: Column) -> Column:
    """Half-even rounding to the tick; a tick of zero or less leaves the price alone."""
    return _tick(money(price), money(tick))


def floor_to_lot(quantity: Column, lot: Column) -> Column:
    """Round down to the lot; a lot of zero or less leaves the quantity alone."""
    q, step = money(quantity), money(lot)
    return money(F.when(step > 0, F.floor(q / F.nullif(step, F.lit(0).cast(MONEY))) * step).otherwise(q))


def unrealized_pnl(side: Column, quantity: Column, entry: Column, mark: Column) -> Column:
    gain = (money(mark) - money(entry)) * money(quantity)
    return F.when(side == "sell", -gain).otherwise(gain)


def basis_points(value: float) -> Column:
    """Basis points as an exact decimal fraction."""
    return F.lit(Decimal(str(value)) / 10_000).cast("decimal(10,8)")


def execution_price(side: Column, reference: Column, tick: Column, spread_bps: float, slippage_bps: float) -> Column:
    """Reference moved against the taker by spread and slippage, then tick-rounded."""
    base = money(reference)
    shift = base * basis_points(spread_bps + slippage_bps)
    return _tick(F.when(side == "buy", base + shift).otherwise(base - shift), money(tick))


def execution_costs(
    reference: Column, executed: Column, quantity: Column, spread_bps: float, slippage_bps: float, taker_fee: float
) -> dict[str, Column]:
    """Spread and slippage are diagnostics on the reference; the fee is on the executed notional."""
    q = money(quantity)
    return {
        "spread_cost": money(reference) * basis_points(spread_bps) * q,
        "slippage_cost": money(reference) * basis_points(slippage_bps) * q,
        "fee": money(executed) * q * F.lit(Decimal(str(taker_fee))).cast("decimal(10,8)"),
    }
