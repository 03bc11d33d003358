"""Accounts from given fills: pairing by window, cash and exposure by running sums, equity by as-of marks.

A fill has an account key, ``at``, ``fill_id`` (order of fills at one time), ``side`` (buy or sell), ``quantity``,
``price`` and ``fee``. In each position key a buy opens and the next fill, if it is a sell, closes all of it: the entry's
quantity counts for both.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.money import notional
from tickloom.operators.ledger import RiskConfig, exit_reason
from tickloom.operators.series import as_of, framed, placed_once, running

ORDER = ("at", "fill_id")
WIDE, TOTAL = "decimal(28,8)", "decimal(36,8)"


def _amount(value: Column) -> Column:
    return value.cast(WIDE)


def opened(fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per position at its entry."""
    return fills.filter("side = 'buy'").select(*keys, "at", "fill_id", "quantity", F.col("price").alias("entry_price"))


def closed(fills: DataFrame, keys: Sequence[str], layout: str = "blocks") -> DataFrame:
    """Entry and exit of every closed position on one row, with gross and net result. Open ones are left out."""
    after = F.struct("side", "at", "price", "fee")
    paired = framed(fills, keys, ORDER, lambda d, w: d.withColumn("_exit", F.lead(after).over(w)), ahead=1, layout=layout)
    gross = notional(F.col("_exit.price"), F.col("quantity")) - notional(F.col("price"), F.col("quantity"))
    out = paired.filter("side = 'buy' AND _exit.side = 'sell'").select(
        *keys, F.col("fill_id").alias("position_id"), F.col("at").alias("opened_at"), F.col("_exit.at").alias("closed_at"), "quantity", F.col("price").alias("entry_price"),
        F.col("_exit.price").alias("exit_price"), _amount(gross).alias("pnl_gross"), _amount(F.col("fee") + F.col("_exit.fee")).alias("fees_paid"))
    return out.withColumns({"pnl_net": F.col("pnl_gross") - F.col("fees_paid"), "status": F.lit("closed")})


def effects(fills: DataFrame, position: Sequence[str], layout: str = "blocks") -> DataFrame:
    """Append what each fill does to its account: cash, held cost, held quantity, open count and realized result."""
    before = F.struct("side", "quantity", "price", "fee")
    linked = framed(fills, position, ORDER, lambda d, w: d.withColumn("_entry", F.lag(before).over(w)), back=1, layout=layout)
    buy = F.col("side") == "buy"
    ends = ~buy & F.coalesce(F.col("_entry.side") == "buy", F.lit(False))
    quantity = F.when(buy, F.col("quantity")).otherwise(F.col("_entry.quantity"))
    value, cost = notional(F.col("price"), quantity), notional(F.col("_entry.price"), quantity)
    zero = F.lit(0).cast(WIDE)
    return linked.withColumns(
        {
            "_cash": F.when(buy, _amount(-value - F.col("fee"))).when(ends, _amount(value - F.col("fee"))).otherwise(zero),
            "_cost": F.when(buy, _amount(value)).when(ends, _amount(-cost)).otherwise(zero),
            "_held": F.when(buy, _amount(quantity)).when(ends, _amount(-quantity)).otherwise(zero),
            "_open": F.when(buy, 1).when(ends, -1).otherwise(0),
            "_net": F.when(ends, _amount(value - cost - F.col("fee") - F.col("_entry.fee"))).otherwise(zero),
        }
    ).drop("_entry")


def account_path(fills: DataFrame, account: Sequence[str], position: Sequence[str], initial_cash: float, *, inclusive: bool = True, layout: str = "blocks") -> DataFrame:
    """Append cash, exposure (cost of what is held), open_positions, held and realized_pnl after each fill.

    ``inclusive=False`` gives the state a fill meets. ``position`` are the columns that name a position, the account's first.
    """
    moved = placed_once(effects(fills, position, layout), account, ORDER, layout)
    names = {"cash": "_cash", "exposure": "_cost", "held": "_held", "open_positions": "_open", "realized_pnl": "_net"}
    path = running(moved, account, ORDER, {n: ("sum", F.col(c)) for n, c in names.items()}, inclusive=inclusive, layout=layout)
    start = F.lit(Decimal(str(initial_cash))).cast(WIDE)
    path = path.withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("long" if n == "open_positions" else TOTAL) for n in names})
    return path.withColumn("cash", path["cash"] + start).drop("_cash", "_cost", "_held", "_open", "_pos")


def entry_limits(fills: DataFrame, account: Sequence[str], position: Sequence[str], config: RiskConfig = RiskConfig(), layout: str = "blocks") -> DataFrame:
    """Each entry with the state it meets and the first limit it breaks: open positions, the day's loss, exposure, cash."""
    met = account_path(fills, account, position, config.initial_cash, inclusive=False, layout=layout)
    met = running(met.withColumn("_day", F.to_date("at")), [*account, "_day"], ORDER, {"realized_today": ("sum", F.col("_net"))}, inclusive=False, layout=layout)
    value = notional(F.col("price"), F.col("quantity"))
    today = F.coalesce("realized_today", F.lit(0).cast(WIDE))
    reason = (
        F.when(F.col("open_positions") >= config.max_open_positions, "max_open_positions_reached")
        .when((today < 0) & (-today >= config.max_daily_loss), "daily_loss_limit_breached")
        .when(F.col("exposure") + value > config.max_total_exposure, "exposure_limit_exceeded")
        .when(F.col("cash") < value, "insufficient_balance")
    )
    return met.filter("side = 'buy'").withColumns({"reason": reason, "realized_today": today}).drop("_net", "_day", "realized_pnl", "held")


def routed(candidates: DataFrame, fills: DataFrame, position: Sequence[str], layout: str = "blocks") -> DataFrame:
    """Append ``reason`` to candidate entries (position key, ``ts``, ``direction`` long or short): what bars them given the positions held."""
    held = account_path(fills, position, position, 0.0, layout=layout).select(*position, "at", "fill_id", "open_positions")
    seen = as_of(candidates, held, position, "ts", "at", ["open_positions"], tie=["fill_id"], layout=layout)
    holds = F.coalesce(F.col("open_positions") > 0, F.lit(False))
    reason = F.when(holds & (F.col("direction") == "long"), "position_already_open").when(~holds & (F.col("direction") == "short"), "short_selling_not_supported")
    return seen.withColumn("reason", reason).drop("open_positions")


def equity_points(fills: DataFrame, marks: DataFrame, account: Sequence[str], initial_cash: float, layout: str = "blocks") -> DataFrame:
    """Cash, equity, unrealized result and ratios of one-instrument accounts at each of their marks (account, ts, price)."""
    path = account_path(fills, account, account, initial_cash, layout=layout)
    state = ["cash", "exposure", "held", "realized_pnl"]
    seen = as_of(marks, path.select(*account, "at", "fill_id", *state), account, "ts", "at", state, tie=["fill_id"], layout=layout)
    zero = F.lit(0).cast(TOTAL)
    start = F.lit(Decimal(str(initial_cash))).cast(WIDE)
    seen = seen.withColumns({"cash": F.coalesce("cash", start), **{c: F.coalesce(c, zero) for c in state[1:]}})
    worth = _amount(F.col("held").cast("decimal(18,8)") * F.col("price").cast("decimal(18,8)"))
    seen = seen.withColumns({"unrealized_pnl": worth - F.col("exposure"), "equity": F.col("cash") + worth})

    def units(c: Column) -> Column:
        # Whole 1e-8ths: the quotient of two is the double next to the exact ratio, so ties stay ties.
        return F.rint(c.cast("double") * 1e8)

    return seen.withColumns({
        "exposure_ratio": F.when(F.col("equity") > 0, units(F.col("exposure")) / F.nullif(units(F.col("equity")), F.lit(0.0))).otherwise(0.0),
        "return_pct": F.when(F.lit(initial_cash > 0), units(F.col("equity") - start) / F.lit(round((initial_cash or 1.0) * 1e8))).otherwise(0.0)})


def exit_choice(positions: DataFrame, marks: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Append ``reason`` of the exit of an open position, first one first: a strategy switch, a limit, the strategy's own signal.

    ``force_exit`` and ``signal_exit`` are boolean columns; positions without reason are left out.
    """
    limit = exit_reason(F.col("side"), F.col("entry_price"), F.col("mark"), config)
    reason = F.when(F.col("force_exit"), "strategy_switch").otherwise(F.coalesce(limit, F.when(F.col("signal_exit"), "signal")))
    return positions.join(marks, "instrument").withColumn("reason", reason).filter("reason IS NOT NULL")
