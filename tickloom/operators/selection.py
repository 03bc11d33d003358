"""Which strategy may trade: viability, market regime, selection and its damping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.stats import clamp
from tickloom.functions.text import strategy_kind
from tickloom.operators.performance import closed_only
from tickloom.operators.series import POS, as_of, framed, placed_once, positions, running

PAIR = ("instrument", "strategy_id")


@dataclass(frozen=True)
class Thresholds:
    """What counts as viable."""

    min_sample_size: int = 10
    min_win_rate: float = 0.35
    min_profit_factor: float = 1.2
    max_drawdown: float = 500.0
    min_confirmations: int = 3


@dataclass(frozen=True)
class RegimeThresholds:
    """What counts as trend, range and breakout."""

    min_r_squared: float = 0.6
    trend_autocorr: float = 0.3
    ranging_r_squared: float = 0.3
    min_relative_volume: float = 1.5


def metrics_as_of(evaluations: DataFrame, trades: DataFrame, layout: str = "blocks", tie: str = "position_id") -> DataFrame:
    """Performance of the pair's trades closed at or before each evaluation's ``as_of``.

    Running aggregates on the trades and one as-of merge: every trade is read once, however many
    evaluations look back at it.
    """
    closed = closed_only(trades)
    net = F.coalesce(F.col("pnl_net"), F.lit(0)).cast("decimal(18,8)")
    order = ["closed_at", tie]
    path = running(
        placed_once(closed, PAIR, order, layout),
        PAIR,
        order,
        {
            "trades": ("count", F.lit(1)),
            "winners": ("count", F.when(net > 0, 1)),
            "losers": ("count", F.when(net < 0, 1)),
            "won": ("sum", F.when(net > 0, net)),
            "lost": ("sum", F.when(net < 0, -net)),
            "net_pnl": ("sum", net),
        },
        layout=layout,
    )
    path = running(path, PAIR, order, {"_top": ("max", F.col("net_pnl"))}, layout=layout)
    peak = F.greatest(F.col("_top"), F.lit(0).cast("decimal(28,8)"))
    path = running(path.withColumn("_fall", peak - F.col("net_pnl")), PAIR, order, {"max_drawdown": ("max", F.col("_fall"))}, layout=layout)
    columns = ["trades", "winners", "losers", "won", "lost", "net_pnl", "max_drawdown"]
    found = as_of(evaluations, path, PAIR, "as_of", "closed_at", columns, tie=[tie], layout=layout)
    n = F.coalesce("trades", F.lit(0))

    def mean(total: str, count: str) -> Column:
        return F.coalesce(F.col(total).cast("double") / F.nullif(F.col(count), F.lit(0)), F.lit(0.0))

    rate = F.coalesce(F.col("winners").cast("double") / F.nullif(F.col("trades"), F.lit(0)), F.lit(0.0))
    return found.select(
        *evaluations.columns,
        n.alias("trades"),
        rate.alias("win_rate"),
        F.coalesce(F.col("net_pnl").cast("double"), F.lit(0.0)).alias("net_pnl"),
        (F.coalesce("won", F.lit(0)).cast("double") / F.nullif(F.col("lost").cast("double"), F.lit(0.0))).alias("profit_factor"),
        (rate * mean("won", "winners") - (1 - rate) * mean("lost", "losers")).alias("expectancy"),
        F.coalesce(F.col("max_drawdown").cast("double"), F.lit(0.0)).alias("max_drawdown"),
    )


# Reasons from most to least severe.
SEVERITY = ("non_positive_expectancy", "below_profit_factor_threshold", "excessive_drawdown", "below_consistency_threshold")


def classify(metrics: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Append ``state`` and ``reason`` to a table of metrics."""
    failed = {
        "non_positive_expectancy": F.col("expectancy") <= 0,
        "below_profit_factor_threshold": F.coalesce(F.col("profit_factor") < t.min_profit_factor, F.lit(False)),
        "excessive_drawdown": F.col("max_drawdown") > t.max_drawdown,
        "below_consistency_threshold": F.col("win_rate") < t.min_win_rate,
    }
    failures = F.array_compact(F.array(*[F.when(failed[name], F.lit(name)) for name in SEVERITY]))
    small = F.col("trades") < t.min_sample_size
    state = (
        F.when(small, "disabled")
        .when(F.size(failures) == 0, "active")
        .when((F.size(failures) == 1) & (failures[0] != "non_positive_expectancy"), "degraded")
        .otherwise("disabled")
    )
    reason = F.when(small, "insufficient_sample").when(F.size(failures) == 0, "meets_all_thresholds").otherwise(F.try_element_at(failures, F.lit(1)))
    return metrics.withColumns({"state": state, "reason": reason})


def damped(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    proposed: str,
    *,
    confirmations: int = 3,
    bypass: Column | None = None,
    revive: bool = False,
    out: str = "held",
    layout: str = "blocks",
) -> DataFrame:
    """Hold a value until ``confirmations`` equal proposals in a row ask for the change.

    Relational form of the state machine: a row *adopts* its proposal when it is the key's first,
    when ``bypass`` is true, or when it ends at least ``confirmations`` equal proposals; the held
    value is the latest adopted one. With ``revive``, a proposal after a held NULL is adopted at
    once; a NULL can only be held behind a run of NULLs that is long enough, began the key or holds
    a bypass, so this too is a matter of the few rows before. ``waiting`` counts unconfirmed
    proposals.
    """
    placed = positions(df, keys, order, layout).withColumn("_by", F.coalesce(bypass, F.lit(False)) if bypass is not None else F.lit(False))
    packed = F.struct(F.col(proposed).alias("v"), F.col("_by").alias("by"))

    def adopt(d: DataFrame, w) -> DataFrame:
        d = d.withColumns({f"_p{k}": F.lag(packed, k).over(w) for k in range(1, confirmations + 1)})
        run = F.lit(1)
        same = F.lit(True)
        for k in range(1, confirmations):
            same = same & F.col(f"_p{k}").isNotNull() & F.col(f"_p{k}.v").eqNullSafe(F.col(proposed))
            run = F.when(same, F.lit(k + 1)).otherwise(run)
        first = F.col("_p1").isNull()
        due = first | F.col("_by") | (run >= confirmations)
        if revive:
            held_null = F.lit(False)
            nulls = F.lit(True)
            for k in range(1, confirmations + 1):
                nulls = nulls & F.col(f"_p{k}").isNotNull() & F.col(f"_p{k}.v").isNull()
                starts = F.col(f"_p{k + 1}").isNull() if k < confirmations else F.lit(True)
                held_null = held_null | (nulls & (F.col(f"_p{k}.by") | starts))
            due = due | F.coalesce(held_null, F.lit(False))
        return d.withColumns({"_run": run, "_adopted": F.when(due, F.struct(F.col(proposed).alias("v")))})

    marked = framed(placed, keys, order, adopt, back=confirmations, layout=layout)
    held = running(marked, keys, [POS], {"_held": ("last", F.col("_adopted"))}, layout=layout)
    changed = ~F.col("_held.v").eqNullSafe(F.col(proposed))
    drop = [f"_p{k}" for k in range(1, confirmations + 1)]
    return held.withColumns({out: F.col("_held.v"), "waiting": F.when(changed, F.col("_run")).otherwise(F.lit(0))}).drop(
        "_held", "_adopted", "_run", "_by", POS, *drop
    )


def held_states(decisions: DataFrame, t: Thresholds = Thresholds(), layout: str = "blocks") -> DataFrame:
    """Per-pair damping of ``state``; a waiting change shows as ``transition_pending``."""
    held = damped(decisions, PAIR, ["as_of"], "state", confirmations=t.min_confirmations, out="_held_state", layout=layout)
    reason = F.when(F.col("waiting") > 0, "transition_pending").otherwise(F.col("reason"))
    return (
        held.withColumn("reason", reason)
        .withColumnRenamed("state", "proposed_state")
        .withColumnRenamed("_held_state", "state")
        .withColumnRenamed("waiting", "confirmations")
    )


def classify_regime(features: DataFrame, t: RegimeThresholds = RegimeThresholds()) -> DataFrame:
    """Append ``regime``, ``regime_strength`` and ``regime_rule``.

    Expects ``prev_bandwidth`` of the plain previous row (``with_previous_bandwidth``).
    """
    b, bw, prev, rv = (F.col(c) for c in ("percent_b", "bandwidth", "prev_bandwidth", "relative_volume"))
    r2, ac, slope = F.col("reg_r2"), F.col("autocorrelation"), F.col("reg_slope")
    breakout = ((b < 0) | (b > 1)) & (bw > prev) & (rv >= t.min_relative_volume)
    trend = (r2 >= t.min_r_squared) & (ac > t.trend_autocorr) & slope.isNotNull()
    calm = (r2 <= t.ranging_r_squared) & (ac <= t.trend_autocorr)
    calm_only = (r2 <= t.ranging_r_squared) & ac.isNull()
    excess = F.when(b > 1, b - 1).otherwise(-b)
    fit = (r2 - t.min_r_squared) / (1 - t.min_r_squared) * 0.5 + clamp(ac - t.trend_autocorr, 0.0, 0.7) / 0.7 * 0.5
    rules = (
        (breakout, "volatility_expansion", clamp(0.55 + excess * 0.3 + clamp(rv - 1) * 0.15), "breakout_expanding_bandwidth_volume"),
        (trend, "trending", F.greatest(clamp(fit), F.lit(0.55)), "trend_r2_and_autocorr"),
        (calm, "ranging", clamp(1 - r2, 0.4, 0.95), "low_r2_and_low_autocorr"),
        (calm_only, "ranging", clamp(1 - r2, 0.35, 0.8), "low_r2_only"),
    )
    chosen = None
    for test, regime, strength, rule in rules:
        value = F.struct(F.lit(regime).alias("regime"), strength.alias("strength"), F.lit(rule).alias("rule"))
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    chosen = chosen.otherwise(F.struct(F.lit("uncertain").alias("regime"), F.lit(0.0).alias("strength"), F.lit("uncertain").alias("rule")))
    return features.withColumn("_r", chosen).withColumns(
        {"regime": F.col("_r.regime"), "regime_strength": F.col("_r.strength"), "regime_rule": F.col("_r.rule")}
    ).drop("_r")


def with_previous_bandwidth(features: DataFrame, keys: Sequence[str] = ("instrument", "timeframe"), layout: str = "blocks") -> DataFrame:
    return framed(features, keys, ["close_time"], lambda d, w: d.withColumn("prev_bandwidth", F.lag("bandwidth").over(w)), back=1, layout=layout)


# How well a strategy kind suits a regime; any other kind scores DEFAULT_AFFINITY.
DEFAULT_AFFINITY = 0.4
AFFINITY = {
    "trending": {
        "momentum": 1.0, "quant_momentum": 1.0, "ema_crossover": 0.9, "volatility_breakout": 0.45,
        "mean_reversion": 0.15, "statistical_mean_reversion": 0.15,
    },
    "ranging": {
        "mean_reversion": 1.0, "statistical_mean_reversion": 1.0, "ema_crossover": 0.2, "momentum": 0.2,
        "quant_momentum": 0.2, "volatility_breakout": 0.25,
    },
    "volatility_expansion": {
        "volatility_breakout": 1.0, "quant_momentum": 0.55, "momentum": 0.55, "ema_crossover": 0.4,
        "mean_reversion": 0.15, "statistical_mean_reversion": 0.15,
    },
    "uncertain": {
        "ema_crossover": 0.75, "mean_reversion": 0.65, "statistical_mean_reversion": 0.65, "momentum": 0.55,
        "quant_momentum": 0.55, "volatility_breakout": 0.25,
    },
}


def affinity_table(spark: SparkSession) -> DataFrame:
    rows = [(regime, kind, score) for regime, kinds in AFFINITY.items() for kind, score in kinds.items()]
    return spark.createDataFrame(rows, "regime string, strategy_kind string, fit_score double")


def with_affinity(df: DataFrame, regime: str = "regime", strategy: str = "strategy_id") -> DataFrame:
    """Join the fixed 24-row score table; unknown kinds get the default."""
    table = F.broadcast(affinity_table(df.sparkSession).withColumnRenamed("regime", regime))
    return (
        df.withColumn("strategy_kind", strategy_kind(F.col(strategy)))
        .join(table, [regime, "strategy_kind"], "left")
        .withColumn("fit_score", F.coalesce("fit_score", F.lit(DEFAULT_AFFINITY)))
    )


def is_bootstrap() -> Column:
    return F.col("reason") == "insufficient_sample"


def is_blocked() -> Column:
    return (F.col("state") == "disabled") & ~is_bootstrap()


def select_strategy(decisions: DataFrame, keys: Sequence[str] = ("context", "as_of"), candidate_order: str = "candidate") -> DataFrame:
    """One row per context and time: the proposed strategy and why.

    ``decisions`` holds one row per candidate with metrics, state, reason, regime and fit_score.
    Full ties go to the last candidate, in an uncertain regime to the greatest id.
    """
    state_rank = F.when(F.col("state") == "active", 2).when(F.col("state") == "degraded", 1).otherwise(0)
    economic = [
        state_rank.alias("s"), F.col("expectancy").alias("e"), F.col("profit_factor").isNull().alias("n"),
        F.coalesce("profit_factor", F.lit(0.0)).alias("p"), (-F.col("max_drawdown")).alias("d"), F.col("net_pnl").alias("m"),
    ]
    fit = F.col("fit_score").alias("f")
    clear = F.struct(fit, *economic, F.col(candidate_order).alias("o"))
    unclear = F.struct(*economic, fit, F.col("strategy_id").alias("i"))
    open_ = ~is_blocked()
    row = F.struct("strategy_id", is_bootstrap().alias("bootstrap"), "fit_score", "strategy_kind")
    picked = decisions.groupBy(*keys).agg(
        F.first("regime").alias("regime"),
        F.max_by(row, F.when(open_, clear)).alias("_clear"),
        F.max_by(row, F.when(open_, unclear)).alias("_unclear"),
        F.bool_and(is_bootstrap()).alias("all_bootstrap"),
    )
    best = F.when(F.col("regime") == "uncertain", F.col("_unclear")).otherwise(F.col("_clear"))
    why = (
        F.when(best.isNull(), "no_viable_candidate")
        .when(F.col("regime") == "uncertain", "economic_fallback")
        .when(best.bootstrap, "regime_bootstrap")
        .otherwise("regime_fit")
    )
    return picked.select(
        *keys, "regime", "all_bootstrap", best.strategy_id.alias("proposed"), best.fit_score.alias("fit_score"),
        F.coalesce(best.bootstrap, F.lit(False)).alias("bootstrap"), why.alias("selection_reason"),
    )


def held_selection(proposals: DataFrame, confirmations: int = 3, layout: str = "blocks") -> DataFrame:
    """Damp the selection per context; an uncertain regime is not damped."""
    held = damped(
        proposals, ["context"], ["as_of"], "proposed", confirmations=confirmations, bypass=F.col("regime") == "uncertain",
        revive=True, out="selected", layout=layout,
    )
    return held.withColumn("selection_reason", F.when(F.col("waiting") > 0, "selection_pending").otherwise(F.col("selection_reason")))


def switches(selections: DataFrame, layout: str = "blocks") -> DataFrame:
    """Rows where the selection differs from the one before (never the first row of a context)."""
    now = F.struct(F.col("selected").alias("v"))
    seen = framed(selections, ["context"], ["as_of"], lambda d, w: d.withColumn("_before", F.lag(now).over(w)), back=1, layout=layout)
    changed = F.col("_before").isNotNull() & ~F.col("_before.v").eqNullSafe(F.col("selected"))
    return seen.filter(changed).withColumn("previous", F.col("_before.v")).drop("_before")


def positions_to_close(open_positions: DataFrame, candidates: DataFrame, selections: DataFrame) -> DataFrame:
    """Open positions of a context's candidates other than its selected one (all if it has none).

    Of a history of selections the latest of each context counts.
    """
    now = selections.groupBy("context").agg(F.max_by(F.struct("as_of", "selected"), "as_of").alias("_s")).select("context", "_s.as_of", "_s.selected")
    owned = open_positions.join(candidates.select("context", "instrument", "strategy_id"), ["instrument", "strategy_id"])
    return owned.join(now, "context").filter(
        ~F.col("strategy_id").eqNullSafe(F.col("selected"))
    )


def gate_signals(signals: DataFrame, decisions: DataFrame, selections: DataFrame) -> DataFrame:
    """Append ``allowed``. Only long signals are gated.

    While nothing (or something without a sample) is selected, every candidate that is not
    economically blocked may open; afterwards only the selected one.
    """
    own = decisions.select("context", "as_of", "strategy_id", "state", "reason")
    chosen = selections.select("context", "as_of", "selected", "all_bootstrap")
    leader = own.select("context", "as_of", F.col("strategy_id").alias("selected"), is_bootstrap().alias("_leader_bootstrap"))
    joined = (
        signals.join(own, ["context", "as_of", "strategy_id"], "left")
        .join(chosen, ["context", "as_of"], "left")
        .join(leader, ["context", "as_of", "selected"], "left")
    )
    early = F.col("selected").isNull() | F.coalesce("_leader_bootstrap", F.lit(False)) | F.coalesce("all_bootstrap", F.lit(False))
    not_blocked = ~F.coalesce(is_blocked(), F.lit(False))
    allowed = (
        F.when(F.col("direction") != "long", True).when(early, not_blocked).otherwise(F.coalesce(F.col("selected") == F.col("strategy_id"), F.lit(False)))
    )
    return joined.select(*signals.columns, allowed.alias("allowed"))
