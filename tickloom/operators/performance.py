"""Trade statistics and equity-curve reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import POS, placed_once, running
from tickloom.session import stable

CENTS = "decimal(38,8)"


def _div(top: Column, bottom: Column) -> Column:
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def trade_statistics(net: Column, gross: Column) -> dict[str, Column]:
    """Aggregates of closed positions; every one combines on the map side."""
    win, loss = net > 0, net < 0
    zero = F.lit(0.0)
    won, lost = F.sum(F.when(win, net)), F.sum(F.when(loss, -net))
    n, winners, losers = F.count(F.lit(1)), F.count_if(win), F.count_if(loss)
    rate = F.coalesce(_div(winners, n), zero)
    aw, al = F.coalesce(_div(won, winners), zero), F.coalesce(_div(lost, losers), zero)
    return {
        "total_trades": n,
        "winners": winners,
        "losers": losers,
        "win_rate": rate,
        "gross_pnl": F.coalesce(F.sum(gross).cast("double"), zero),
        "net_pnl": F.coalesce(F.sum(net).cast("double"), zero),
        "average_win": aw,
        "average_loss": al,
        "profit_factor": _div(F.coalesce(won, F.lit(0)), lost),
        # Break-even trades count as losses in the probability.
        "expectancy": rate * aw - (1 - rate) * al,
        "total_fees": F.coalesce(F.sum("fees_paid").cast("double"), zero),
        "total_spread_cost": F.coalesce(F.sum("spread_paid").cast("double"), zero),
        "total_slippage_cost": F.coalesce(F.sum("slippage_paid").cast("double"), zero),
        "average_duration_s": F.coalesce(
            F.floor(F.sum(F.unix_micros("closed_at") - F.unix_micros("opened_at")) / n / 1_000_000).cast("long"), F.lit(0)
        ),
    }


def closed_only(positions: DataFrame) -> DataFrame:
    return positions.filter("status = 'closed'")


def performance(positions: DataFrame, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """One row of trade statistics per key (without drawdown, see ``with_drawdown``)."""
    stats = trade_statistics(F.coalesce(F.col("pnl_net"), F.lit(0)), F.coalesce(F.col("pnl_gross"), F.lit(0)))
    return closed_only(positions).groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])


def drawdown_path(positions: DataFrame, keys: Sequence[str], tie: str = "position_id", layout: str = "blocks") -> DataFrame:
    """Running net, its peak (never below 0) and the distance to it, in close order."""
    order = ["closed_at", tie]
    net = F.coalesce(F.col("pnl_net"), F.lit(0)).cast("decimal(18,8)")
    closed = placed_once(closed_only(positions), keys, order, layout)
    path = running(closed, keys, order, {"cumulative_net": ("sum", net)}, layout=layout)
    path = running(path, keys, order, {"_top": ("max", F.col("cumulative_net"))}, layout=layout)
    peak = F.greatest(F.col("_top"), F.lit(0).cast("decimal(28,8)"))
    return path.withColumn("peak", peak).withColumn("drawdown", peak - F.col("cumulative_net")).drop("_top", POS)


def max_drawdown(positions: DataFrame, keys: Sequence[str] = ("strategy_id",), tie: str = "position_id", layout: str = "blocks") -> DataFrame:
    return drawdown_path(positions, keys, tie, layout).groupBy(*keys).agg(F.max("drawdown").cast("double").alias("max_drawdown"))


def with_drawdown(positions: DataFrame, keys: Sequence[str] = ("strategy_id",), tie: str = "position_id", layout: str = "blocks") -> DataFrame:
    return performance(positions, keys).join(max_drawdown(positions, keys, tie, layout), list(keys))


def rollup(positions: DataFrame, as_of: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics by strategy, ``keys`` and UTC day of close of what was closed by ``as_of``, stamped with it: rows to append."""
    known = closed_only(positions).filter(F.col("closed_at") <= as_of).withColumn("day_us", F.unix_micros(F.date_trunc("day", "closed_at")))
    return performance(known, [*keys, "strategy_id", "day_us"]).withColumn("as_of_us", F.unix_micros(as_of))


def complete(report: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without a single closed trade still get a row of zeros."""
    counts = {f.name for f in report.schema.fields if f.name not in keys and f.name != "profit_factor"}
    return wanted.join(report, list(keys), "left").fillna(0, subset=sorted(counts))


def period_returns(equity: DataFrame, period: Column, keys: Sequence[str], initial: float, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Last equity of each period and its return on the previous one (the first on ``initial``).

    The aggregate leaves one row per calendar period, so the window sees days, not snapshots.
    """
    ends = equity.groupBy(*keys, period.alias("period")).agg(F.max_by("equity", F.struct(ts, tie)).cast("double").alias("equity"))
    w = Window.partitionBy(*keys).orderBy("period")
    before = F.lag("equity", 1, initial).over(w)
    return ends.withColumn("return_pct", F.coalesce((F.col("equity") - before) / F.nullif(before, F.lit(0.0)), F.lit(0.0)))


def daily_returns(equity: DataFrame, keys: Sequence[str], initial: float, **names: str) -> DataFrame:
    return period_returns(equity, F.to_date(names.get("ts", "ts")), keys, initial, **names)


def monthly_returns(equity: DataFrame, keys: Sequence[str], initial: float, **names: str) -> DataFrame:
    return period_returns(equity, F.trunc(F.to_date(names.get("ts", "ts")), "month"), keys, initial, **names)


def annual_returns(equity: DataFrame, keys: Sequence[str], initial: float, **names: str) -> DataFrame:
    return period_returns(equity, F.trunc(F.to_date(names.get("ts", "ts")), "year"), keys, initial, **names)


def daily_summary(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = F.col("return_pct")
    return daily.groupBy(*keys).agg(
        F.avg(r).alias("average_daily_return_pct"),
        F.count_if(r > 0).alias("positive_days"),
        F.count_if(r < 0).alias("negative_days"),
        F.count_if(r == 0).alias("flat_days"),
    )


def max_drawdown_pct(equity: DataFrame, keys: Sequence[str], ts: str = "ts", tie: str = "seq", layout: str = "blocks") -> DataFrame:
    """Over every snapshot, not only day ends."""
    path = running(equity, keys, [ts, tie], {"_peak": ("max", F.col("equity"))}, layout=layout)
    peak = F.greatest(F.col("_peak").cast("double"), F.lit(0.0))
    fall = (peak - F.col("equity").cast("double")) / F.nullif(peak, F.lit(0.0))
    return path.groupBy(*keys).agg(F.greatest(F.coalesce(F.max(fall), F.lit(0.0)), F.lit(0.0)).alias("max_drawdown_pct"))


def equity_report(equity: DataFrame, keys: Sequence[str], initial: float, ts: str = "ts", tie: str = "seq", layout: str = "blocks") -> DataFrame:
    """Net return, daily figures, monthly and annual returns and drawdown on one row per key."""
    names = {"ts": ts, "tie": tie}
    # Five aggregates read the curve.
    equity = stable(equity.select(*keys, ts, tie, "equity", "return_pct"))
    last = equity.groupBy(*keys).agg(F.max_by("return_pct", F.struct(ts, tie)).cast("double").alias("net_return_pct"))
    daily = daily_summary(daily_returns(equity, keys, initial, **names), keys)

    def listed(table: DataFrame, name: str) -> DataFrame:
        # Calendar months and years: a bounded list.
        return table.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("period", "return_pct"))).alias(name))

    return (
        last.join(daily, list(keys))
        .join(max_drawdown_pct(equity, keys, ts, tie, layout), list(keys))
        .join(listed(monthly_returns(equity, keys, initial, **names), "monthly_returns"), list(keys))
        .join(listed(annual_returns(equity, keys, initial, **names), "annual_returns"), list(keys))
    )
