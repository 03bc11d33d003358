"""Parameter sweeps: the runs of (symbol, timeframe, window, strategy) and reports of their given trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import candles as C
from tickloom.operators.performance import complete, equity_report, max_drawdown, performance
from tickloom.operators.series import running
from tickloom.operators.signals import CATALOG
from tickloom.session import stable

RUN = ("symbol", "timeframe", "window", "strategy_id")
SLICE = ("symbol", "timeframe", "window")


def matrix(slices: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Run keys: each slice with each strategy kind (a short literal list is exploded)."""
    names = F.array(*[F.lit(k) for k in (kinds or list(CATALOG))])
    return slices.select(*SLICE).withColumn("strategy_id", F.explode(names))


def windowed(candles: DataFrame) -> DataFrame:
    """Every look-back window as a series of its own: indicators warm up inside it."""
    cut = C.recent_windows(C.closed_only(candles).withColumn("symbol", F.col("instrument")))
    return cut.withColumn("instrument", F.concat_ws("@", "symbol", "window"))


def strict(slices: DataFrame, timeframe: str, layout: str = "blocks", seq: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of clean slices, skipped slices, validation report).

    ``seq`` names the order of arrival, unique in a slice; without it rows count as arrived by open time, which shows gaps only.
    """
    placed = slices if seq else slices.withColumn("seq", F.unix_micros("open_time"))
    audited = C.audit(placed, timeframe, seq=seq or "seq", keys=SLICE, layout=layout)
    report = C.validation_report(audited, SLICE)
    kept, skipped = C.strict_gate(slices, report, SLICE)
    return kept, skipped, report


def run_data(slices: DataFrame, report: DataFrame) -> DataFrame:
    """What each slice ran on: its period, candles used, data quality (the report of ``strict``) and buy-and-hold return."""
    spans = slices.groupBy(*SLICE).agg(F.min("open_time").alias("period_start"), F.max("close_time").alias("period_end"))
    return spans.join(report.withColumnRenamed("rows", "candles_used"), list(SLICE)).join(C.buy_and_hold(slices, SLICE), list(SLICE))


def trades_in_slices(trades: DataFrame, data: DataFrame) -> DataFrame:
    """Given closed trades (symbol, timeframe, strategy_id, opened_at, closed_at), once for each slice of ``data`` (``run_data``)
    in whose period they were opened and closed. A series has as many slices as there are look-back windows."""
    spans = data.select(*SLICE, "period_start", "period_end")
    within = (F.col("opened_at") >= F.col("period_start")) & (F.col("closed_at") <= F.col("period_end"))
    return trades.join(spans, ["symbol", "timeframe"]).filter(within).drop("period_start", "period_end")


def trades_by_window(trades: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Given closed trades (keys, strategy_id, opened_at, closed_at), once for each look-back window they lie in.

    A window ends at the latest close of its keys and takes the trades opened within it.
    """
    spans = C.recent_windows(trades.withColumns({"close_time": F.col("closed_at"), "open_time": F.col("opened_at")}), keys)
    return spans.drop("close_time", "open_time")


def experiment_reports(trades: DataFrame, report: DataFrame, cash: float, kinds: Sequence[str] | None = None, layout: str = "blocks") -> DataFrame:
    """One row per run of ``report`` (a row a slice: ``run_data``, or any columns to carry) and strategy kind: performance,
    equity, returns and drawdown of the given trades (``trades_in_slices``); runs without trades too, with zeros."""
    trades = stable(trades)
    keys = matrix(report.select(*SLICE).distinct(), kinds)
    done = performance(trades, RUN).join(max_drawdown(trades, RUN, layout=layout), list(RUN))
    path = running(trades, RUN, ["closed_at", "position_id"], {"_net": ("sum", F.col("pnl_net"))}, layout=layout)
    equity = path.select(*RUN, F.col("closed_at").alias("ts"), F.col("position_id").alias("seq"), (F.col("_net").cast("double") + cash).alias("equity"), (F.col("_net").cast("double") / cash).alias("return_pct"))
    curve = equity_report(equity, RUN, cash, layout=layout)
    curve_figures = ["average_daily_return_pct", "positive_days", "negative_days", "flat_days", "max_drawdown_pct"]
    out = complete(done, keys, RUN).join(curve, list(RUN), "left").fillna(0, subset=curve_figures).join(report, list(SLICE))
    return out.withColumns({"initial_balance": F.lit(cash), "gross_return_pct": F.col("gross_pnl") / F.lit(cash), "net_return_pct": F.coalesce("net_return_pct", F.lit(0.0))})


# Fewer trades than this say nothing; classes in report order.
MIN_TRADES = 30
WINDOW_ORDER = {"24m": 0, "12m": 1, "6m": 2, "3m": 3}
# A baseline and the quantitative strategy it is compared with.
PAIRS = (("ema_crossover", "quant_momentum"), ("momentum", "volatility_breakout"), ("mean_reversion", "statistical_mean_reversion"))


def classify(trades: Column, gross: Column, net: Column) -> Column:
    return F.when(trades < MIN_TRADES, "LOW_SAMPLE").when(gross <= 0, "NO_EDGE").when(net <= 0, "FRICTION_LIMITED").otherwise("NET_POSITIVE")


def diagnostics(reports: DataFrame) -> DataFrame:
    """Costs and class of each run."""
    costs = F.col("total_fees") + F.col("total_spread_cost") + F.col("total_slippage_cost")
    return reports.withColumns(
        {
            "total_costs": costs,
            "costs_pct": F.coalesce(costs / F.nullif(F.col("initial_balance"), F.lit(0.0)), F.lit(0.0)),
            "class": classify(F.col("total_trades"), F.col("gross_return_pct"), F.col("net_return_pct")),
        }
    )


def consistency(diagnosed: DataFrame) -> DataFrame:
    """Classes of a strategy over its windows, longest first; consistent if all are equal."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WINDOW_ORDER.items() for x in kv]), F.col("window")), F.lit(len(WINDOW_ORDER)))
    # As many entries as look-back windows.
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("o"), "window", "class")))
    out = diagnosed.groupBy("symbol", "timeframe", "strategy_id").agg(listed.alias("_l"))
    classes = F.transform("_l", lambda x: x["class"])
    return out.select("symbol", "timeframe", "strategy_id", F.transform("_l", lambda x: F.concat_ws("=", x["window"], x["class"])).alias("classes"), (F.size(F.array_distinct(classes)) <= 1).alias("consistent"))


def pairs(diagnosed: DataFrame) -> DataFrame:
    """Baseline beside its quantitative counterpart where both ran."""
    partner = F.create_map(*[F.lit(x) for b, q in PAIRS for x in (b, q)])
    base = diagnosed.select(*SLICE, F.col("strategy_id").alias("baseline"), F.try_element_at(partner, F.col("strategy_id")).alias("quant"), F.col("net_return_pct").alias("baseline_net"), F.col("class").alias("baseline_class"))
    quant = diagnosed.select(*SLICE, F.col("strategy_id").alias("quant"), F.col("net_return_pct").alias("quant_net"), F.col("class").alias("quant_class"))
    return base.filter("quant IS NOT NULL").join(quant, [*SLICE, "quant"])
