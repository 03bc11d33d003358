"""Reporting queries over trades, positions, snapshots, decisions and evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.money import unrealized_pnl
from tickloom.functions.text import instance_id, is_test_strategy
from tickloom.operators.joins import first_match, interval_latest, latest_per, recent
from tickloom.operators.performance import performance
from tickloom.operators.series import as_of, running, small_side
from tickloom.session import stable

TIMEFRAMES = ("1m", "5m", "15m", "30m", "1h", "4h", "1d", "1w")


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks; NULL outcomes count as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def conform(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, quarantine with the broken rules)."""
    checked = df.withColumn("violations", violations(rules))
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def market_rules() -> dict[str, Column]:
    return {
        "symbol": F.col("symbol").rlike("^[A-Z0-9]+/[A-Z0-9]+$"),
        "price": F.col("price") > 0,
        "quantity": F.col("quantity") > 0,
        "confidence": F.col("confidence").between(0.0, 1.0),
        "strategy_id": F.trim("strategy_id") != "",
        "side": F.col("side").isin("buy", "sell"),
        "timeframe": F.col("timeframe").isin(*TIMEFRAMES),
    }


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    return latest_per(snapshots, ["robot_id"], ["ts", "seq"])


def portfolio_rollup(latest: DataFrame) -> DataFrame:
    """Cash and equity of all robots; return and exposure weighted by equity."""
    e = F.col("equity").cast("double")
    total = F.sum(e)

    def weighted(c: str) -> Column:
        return F.when(total > 0, F.sum(F.col(c) * e) / F.nullif(total, F.lit(0.0))).otherwise(0.0)

    return latest.agg(
        F.sum(F.col("cash").cast("double")).alias("cash"), total.alias("equity"), weighted("return_pct").alias("return_pct"),
        weighted("exposure_ratio").alias("exposure_ratio"), F.max("ts").alias("as_of"),
    )


def open_positions(positions: DataFrame, marks: DataFrame, instruments: DataFrame) -> DataFrame:
    """Open positions with symbol ('?' if unknown), mark, unrealized P&L and distance from entry."""
    joined = (
        positions.filter("status = 'open'")
        .join(marks.select("instrument", F.col("price").alias("mark")), "instrument", "left")
        .join(instruments.select("instrument", "symbol"), "instrument", "left")
    )
    entry, mark = F.col("entry_price"), F.col("mark")
    return joined.withColumns(
        {
            "symbol": F.coalesce("symbol", F.lit("?")),
            "unrealized_pnl": unrealized_pnl(F.col("side"), F.col("quantity"), entry, mark),
            "entry_notional": (entry * F.col("quantity")).cast("double"),
            "delta_pct": F.when(entry == 0, 0.0).otherwise((mark - entry).cast("double") / F.nullif(entry.cast("double"), F.lit(0.0)) * 100),
        }
    )


def exposure(positions: DataFrame) -> DataFrame:
    """What is at stake now: quantity at the mark, or at entry where there is none."""
    price = F.coalesce("mark", "entry_price")
    return positions.agg(F.coalesce(F.sum((price * F.col("quantity")).cast("double")), F.lit(0.0)).alias("exposed"), F.count(F.lit(1)).alias("open_count"))


def realized_total(positions: DataFrame) -> DataFrame:
    return positions.filter("status = 'closed'").agg(F.coalesce(F.sum("pnl_net").cast("double"), F.lit(0.0)).alias("realized_pnl"))


def overview(positions: DataFrame, marks: DataFrame, snapshots: DataFrame, drawdown: DataFrame) -> DataFrame:
    """One row: rolled-up portfolio, realized and unrealized P&L, drawdown, open positions.

    Each part is an aggregate of one row, so joining them moves nothing.
    """
    real = positions.filter(~is_test_strategy(F.col("strategy_id")))
    rollup = portfolio_rollup(latest_snapshots(snapshots))
    marked = real.filter("status = 'open'").join(marks.select("instrument", F.col("price").alias("mark")), "instrument", "left")
    pnl = unrealized_pnl(F.col("side"), F.col("quantity"), F.col("entry_price"), F.coalesce("mark", "entry_price"))
    unrealized = marked.agg(F.coalesce(F.sum(pnl).cast("double"), F.lit(0.0)).alias("unrealized_pnl"), F.count(F.lit(1)).alias("open_positions"))
    days = real.filter("status = 'closed'").groupBy(F.to_date("closed_at").alias("day")).agg(F.sum("pnl_net").cast("double").alias("net"))
    one = F.lit(1).alias("_one")
    daily = days.join(rollup.select(F.to_date("as_of").alias("today"), one), F.lit(True), "left").agg(
        F.coalesce(F.sum("net"), F.lit(0.0)).alias("realized_pnl_total"),
        F.coalesce(F.sum(F.when(F.col("day") == F.col("today"), F.col("net"))), F.lit(0.0)).alias("realized_pnl_today"),
    )
    parts = [rollup, unrealized, daily, drawdown]
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def timeline(decisions: DataFrame, instruments: DataFrame, signals: DataFrame, orders: DataFrame, fills: DataFrame, trades: DataFrame, n: int) -> DataFrame:
    """Newest n decisions with what came of them.

    The n decisions are picked first. The four big tables are then cut to their at most n matching
    keys by a semi-join against that bounded set before they are joined.
    """
    known = decisions.join(instruments.select("instrument", "symbol"), "instrument")
    top = recent(known, "created_at", n, "id")
    wanted_orders, wanted_signals = top.select("order_id").filter("order_id IS NOT NULL"), top.select("signal_id").filter("signal_id IS NOT NULL")

    def cut(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        return table.join(keys, key, "left_semi")

    return recent(
        top.join(cut(signals, wanted_signals, "signal_id"), "signal_id", "left")
        .join(cut(orders, wanted_orders, "order_id"), "order_id", "left")
        .join(cut(fills, wanted_orders, "order_id"), "order_id", "left")
        .join(cut(trades, wanted_orders, "order_id"), "order_id", "left"),
        "created_at",
        n,
        "id",
    )


def robot_overview(robots: DataFrame, active: DataFrame, snapshots: DataFrame, positions: DataFrame) -> DataFrame:
    """Robot with its candidate instances, selection, latest snapshot, performance and open count."""
    ids = robots.select("robot_id", F.explode("candidate_kinds").alias("kind")).withColumn("strategy_id", instance_id(F.col("robot_id"), F.col("kind")))
    owned = positions.join(ids.select("robot_id", "strategy_id"), "strategy_id")
    stats = performance(owned, ["robot_id"]).select("robot_id", "total_trades", "net_pnl", "win_rate", "profit_factor", "expectancy")
    opened = owned.filter("status = 'open'").groupBy("robot_id").agg(F.count(F.lit(1)).alias("open_count"))
    chosen = active.join(ids.select("robot_id", F.col("strategy_id").alias("selected")), ["robot_id", "selected"], "left_semi")
    snaps = latest_snapshots(snapshots).select("robot_id", "cash", "equity", "return_pct")
    joined = robots.join(chosen, "robot_id", "left").join(snaps, "robot_id", "left").join(stats, "robot_id", "left").join(opened, "robot_id", "left")
    return joined.withColumns(
        {
            "cash": F.coalesce("cash", "paper_capital"),
            "equity": F.coalesce("equity", "paper_capital"),
            "return_pct": F.coalesce("return_pct", F.lit(0.0)),
            "total_trades": F.coalesce("total_trades", F.lit(0)),
            "open_count": F.coalesce("open_count", F.lit(0)),
            "net_pnl": F.coalesce("net_pnl", F.lit(0.0)),
        }
    )


EXIT_TRIGGERS = ("strategy_switch", "stop_loss", "take_profit")


def trade_context(trades: DataFrame, decisions: DataFrame) -> DataFrame:
    """Trades with the decision that opened and the one that closed them."""
    approved = F.col("approved")
    leaving = F.col("trigger").isin(*EXIT_TRIGGERS) | ((F.col("trigger") == "signal") & F.col("direction").isin("short", "flat"))
    exits = decisions.withColumn("closed_at", F.col("created_at"))
    entries = decisions.withColumn("opened_at", F.col("created_at"))
    out = first_match(trades, exits, ["strategy_id", "closed_at"], approved & leaving, ["id"], ["trigger", "reason"], "exit_")
    long_entry = approved & (F.col("trigger") == "signal") & (F.col("direction") == "long")
    return first_match(out, entries, ["strategy_id", "opened_at"], long_entry, ["id"], ["direction", "confidence"], "entry_")


def cumulative_pnl(trades: DataFrame, keys: Sequence[str], layout: str = "blocks") -> DataFrame:
    return running(trades, keys, ["closed_at", "position_id"], {"cumulative_pnl": ("sum", F.col("pnl_net"))}, layout=layout)


def trade_export(trades: DataFrame, evaluations: DataFrame, strategy_switches: DataFrame, context: Sequence[str], layout: str = "blocks") -> DataFrame:
    """Trades with the evaluation in force at entry and the latest switch around their life.

    What else evaluations say of regime and selection, and switches of their reason, comes along where it is there.
    """
    more = [c for c in ("regime_strength", "regime_summary", "selection_summary") if c in evaluations.columns]
    judged = as_of(trades, evaluations, context, "opened_at", "evaluated_at", ["evaluated_at", "selected", "regime", *more], ["evaluation_id"], prefix="judge_", layout=layout)
    reason = [c for c in ("reason",) if c in strategy_switches.columns]
    return interval_latest(
        judged, strategy_switches, context, "opened_at", "closed_at", "switched_at", ["previous", "selected", "switched_at", *reason], tie=["switch_id"], prefix="switch_", layout=layout
    )


# Columns of the trade file.
TRADE_FILE = (
    "trade_id", "robot_id", "robot_name", "symbol", "timeframe", "strategy_id", "strategy", "direction", "entry_confidence", "quantity", "entry_price", "exit_price", "opened_at", "closed_at",
    "duration", "pnl_gross", "fees_paid", "spread_paid", "slippage_paid", "pnl_net", "exit_trigger", "exit_reason", "regime_at_entry", "regime_strength", "regime_summary", "selection_summary",
    "judge_selected_strategy", "judge_evaluated_at", "related_switch", "related_switch_reason", "related_switch_at",
)


def held(opened: Column, closed: Column) -> Column:
    """A holding time in hours and minutes, to the nearest minute; a dash if it ends before it begins."""
    micros = F.unix_micros(closed) - F.unix_micros(opened)
    minutes = F.floor((micros + 30_000_000) / 60_000_000)
    hours = F.floor(minutes / 60)
    rest = F.concat((minutes % 60).cast("string"), F.lit("m"))
    return (F.when(micros.isNull() | (micros < 0), "\u2014").when(minutes < 1, "<1m")
            .when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), rest)).otherwise(rest))


def trade_file(exported: DataFrame, robots: DataFrame) -> DataFrame:
    """Rows of ``trade_export`` with their robots (robot_id, robot_name, instrument, timeframe) in the columns of the trade file.

    A trade belongs to the robot of its ``robot_id`` if it has one, else to that of its instrument. Strategies are their
    kinds, directions, triggers, regimes and reasons their codes (sentences are the reader's), times ISO text. Columns
    that trades or evaluations lack are null, and so is the robot of a trade that has none; no trade is lost.
    """
    by = "robot_id" if "robot_id" in exported.columns else "instrument"
    # Few robots own all trades: a counted table of them goes to the trades, or one robot's trades would be one task.
    named = small_side(stable(robots.select(by, *[c for c in ("robot_id", "robot_name", "timeframe") if c != by])))
    joined = exported.join(named, by, "left")

    def known(name: str) -> Column:
        return F.col(name) if name in exported.columns else F.lit(None).cast("string")

    def kind(name: str) -> Column:
        # Instances are named prefix::kind or kind@instrument.
        return F.substring_index(F.substring_index(known(name), "::", -1), "@", 1)

    def iso(name: str) -> Column:
        return F.date_format(known(name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    direction = F.coalesce(known("entry_direction"), F.when(F.lower("side") == "buy", "long").otherwise(F.col("side")))
    switch = F.when(F.col("switch_switched_at").isNotNull(), F.concat(F.coalesce(kind("switch_previous"), F.lit("none")), F.lit(" > "), F.coalesce(kind("switch_selected"), F.lit("none"))))
    made = {
        "trade_id": F.col("position_id"), "symbol": F.col("instrument"), "strategy": kind("strategy_id"), "direction": direction, "opened_at": iso("opened_at"), "closed_at": iso("closed_at"),
        "duration": held(F.col("opened_at"), F.col("closed_at")), "regime_at_entry": known("judge_regime"), "regime_strength": known("judge_regime_strength"),
        "regime_summary": known("judge_regime_summary"), "selection_summary": known("judge_selection_summary"), "judge_selected_strategy": kind("judge_selected"),
        "judge_evaluated_at": iso("judge_evaluated_at"), "related_switch": switch, "related_switch_reason": known("switch_reason"), "related_switch_at": iso("switch_switched_at"),
        **{c: F.col(c) for c in ("robot_id", "robot_name", "timeframe")},
    }
    return joined.select(*[made.get(c, known(c)).alias(c) for c in TRADE_FILE])


def decision_rows(evaluations: DataFrame) -> DataFrame:
    """One row per candidate inside each evaluation payload; both payload versions are read."""
    return decode_evaluations(evaluations).select("evaluation_id", "payload_version", F.explode("decisions").alias("d")).select(
        "evaluation_id", "payload_version", "d.strategy_id", "d.state", F.col("d.reason.kind").alias("reason"), "d.metrics.trades"
    )


DECISION_DDL = (
    "struct<strategy_id: string, state: string, metrics: struct<trades: bigint, net_pnl: string, win_rate: string>, reason: struct<kind: string>>"
)


def encode_evaluations(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One version-2 JSON payload per evaluation from its candidate rows (a bounded list of strategies)."""
    decision = F.struct(
        "strategy_id", "state", F.struct("trades", F.col("net_pnl").cast("string").alias("net_pnl"), F.col("win_rate").cast("string").alias("win_rate")).alias("metrics"),
        F.struct(F.col("reason").alias("kind")).alias("reason"),
    )
    packed = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(decision)).alias("decisions"), F.first("regime").alias("regime"))
    return packed.select(*keys, F.to_json(F.struct(F.lit(2).alias("version"), F.struct(F.col("regime").alias("kind")).alias("regime"), "decisions")).alias("payload"))


def decode_evaluations(evaluations: DataFrame) -> DataFrame:
    """Version 1 is a bare array of decisions, version 2 an object holding it."""
    is_array = F.ltrim("payload").startswith("[")
    v2 = F.from_json(F.when(~is_array, F.col("payload")), f"struct<version: int, regime: struct<kind: string>, decisions: array<{DECISION_DDL}>>")
    v1 = F.from_json(F.when(is_array, F.col("payload")), f"array<{DECISION_DDL}>")
    return evaluations.withColumns({"_v2": v2, "_v1": v1}).withColumns(
        {"payload_version": F.when(is_array, 1).otherwise(2), "regime": F.col("_v2.regime.kind"), "decisions": F.coalesce("_v2.decisions", "_v1")}
    ).drop("_v1", "_v2")


def judge_timeline(evaluations: DataFrame, strategy_switches: DataFrame, n_switches: int = 20, n_evaluations: int = 24, n: int = 36) -> DataFrame:
    """Newest switches and evaluations as one list; each side is cut before the union."""
    s = recent(strategy_switches, "at", n_switches, "id").select("at", F.lit("switch").alias("kind"), "id")
    e = recent(evaluations, "at", n_evaluations, "id").select("at", F.lit("evaluation").alias("kind"), "id")
    return s.unionByName(e).orderBy(F.col("at").desc(), "kind", F.col("id").desc()).limit(n)


def relative_bar(per_strategy: DataFrame) -> DataFrame:
    """Absolute net of each strategy against the largest one (at least 1)."""
    top = per_strategy.agg(F.greatest(F.lit(1.0), F.max(F.abs("net_pnl"))).alias("_top"))
    return per_strategy.withColumn("_one", F.lit(1)).join(top.withColumn("_one", F.lit(1)), "_one").withColumn(
        "bar", F.abs("net_pnl") / F.col("_top")
    ).drop("_one", "_top")
