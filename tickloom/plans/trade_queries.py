"""Registered queries of closed trades, equity curves and strategy selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import performance as P
from tickloom.operators import selection as J
from tickloom.operators.series import measured_layout
from tickloom.plans.adapters import (
    EQUITY_SQL,
    EVALUATIONS_SQL,
    INITIAL_CASH,
    TRADES_SQL,
    Columns,
    bars,
    bars_sql,
    closed_trades,
    equity,
    evaluations,
    load,
    r6,
    tape_layout,
    us,
)
from tickloom.plans.registry import Registry
from tickloom.session import scratch_path
from tickloom.sources import lake as K
from tickloom.session import stable

R = Registry()
COUNTS = ("total_trades", "winners", "losers")
FIGURES = ("win_rate", "gross_pnl", "net_pnl", "average_win", "average_loss", "profit_factor", "expectancy", "total_fees",
           "total_spread_cost", "total_slippage_cost")


def report_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *COUNTS, *[r6(c) for c in FIGURES], "average_duration_s")


def performance_sql(key: str, source: str = "trades", where: str = "") -> str:
    """Statistics with nullif/coalesce spelled out, for any grouping key."""
    return f"""stats AS (
  SELECT {key}, count(*) AS n, count(*) FILTER (pnl_net > 0) AS w, count(*) FILTER (pnl_net < 0) AS l,
   coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0)::DOUBLE AS won, coalesce(-sum(pnl_net) FILTER (pnl_net < 0), 0)::DOUBLE AS lost,
   sum(pnl_gross)::DOUBLE AS g, sum(pnl_net)::DOUBLE AS net, sum(fees_paid)::DOUBLE AS fees, sum(spread_paid)::DOUBLE AS sp,
   sum(slippage_paid)::DOUBLE AS sl, CAST(sum(epoch_us(closed_at) - epoch_us(opened_at)) AS DOUBLE) AS dur
  FROM {source} {where} GROUP BY ALL),
 report AS (
  SELECT *, n AS total_trades, w AS winners, l AS losers, w::DOUBLE / n AS win_rate, g AS gross_pnl, net AS net_pnl,
   coalesce(won / nullif(w, 0), 0) AS average_win, coalesce(lost / nullif(l, 0), 0) AS average_loss, won / nullif(lost, 0) AS profit_factor,
   w::DOUBLE / n * coalesce(won / nullif(w, 0), 0) - (1 - w::DOUBLE / n) * coalesce(lost / nullif(l, 0), 0) AS expectancy,
   fees AS total_fees, sp AS total_spread_cost, sl AS total_slippage_cost, CAST(floor(dur / n / 1000000) AS BIGINT) AS average_duration_s
  FROM stats)"""


def report_sql(*keys: str) -> str:
    return f"SELECT {', '.join([*keys, *COUNTS])}, {', '.join(f'round({c}, 6) AS {c}' for c in FIGURES)}, average_duration_s FROM report"


R.add("perf_trades", lambda s, d: report_columns(P.performance(closed_trades(s, d)), "strategy_id"),
      f"WITH {TRADES_SQL}, {performance_sql('strategy_id')} {report_sql('strategy_id')}")
R.add("perf_group",
      lambda s, d: report_columns(P.performance(closed_trades(s, d).withColumn("day_us", F.unix_micros("closed_at")), ["instrument", "day_us"]), "instrument", "day_us"),
      f"WITH {TRADES_SQL}, {performance_sql('instrument, epoch_us(closed_at) AS day_us')} {report_sql('instrument', 'day_us')}")


def rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends of the strategies' figures by robot and UTC day of close: as of the middle of the closes, and of their end."""
    t = closed_trades(spark, sf_dir)
    ends = t.agg(F.min(F.unix_micros("closed_at")), F.max(F.unix_micros("closed_at"))).first()
    path = scratch_path(spark, "rollup")
    for as_of in (((ends[0] or 0) + (ends[1] or 0)) // 2, ends[1] or 0):
        K.append_table(P.rollup(t, F.timestamp_micros(F.lit(as_of)), ["instrument"]), path, ["as_of_us"])
    return report_columns(spark.read.parquet(path), "instrument", "strategy_id", "day_us", "as_of_us")


R.add("perf_rollup", rolled_up,
      f"""WITH {TRADES_SQL}, e AS (SELECT (epoch_us(min(closed_at)) + epoch_us(max(closed_at))) // 2 AS mid, epoch_us(max(closed_at)) AS stop FROM trades),
 runs AS (SELECT t.*, epoch_us(date_trunc('day', closed_at)::TIMESTAMP) AS day_us, a AS as_of_us FROM trades t, (SELECT unnest([mid, stop]) AS a FROM e) WHERE epoch_us(closed_at) <= a),
 {performance_sql('instrument, strategy_id, day_us, as_of_us', 'runs')} {report_sql('instrument', 'strategy_id', 'day_us', 'as_of_us')}""")
R.add("perf_max_drawdown", lambda s, d: P.max_drawdown(closed_trades(s, d), layout=layout_of(s, d)).select("strategy_id", r6("max_drawdown")),
      f"""WITH {TRADES_SQL}, c AS (SELECT *, sum(pnl_net) OVER (PARTITION BY strategy_id ORDER BY closed_at, position_id) AS cum FROM trades),
 p AS (SELECT *, greatest(max(cum) OVER (PARTITION BY strategy_id ORDER BY closed_at, position_id), 0) AS peak FROM c)
 SELECT strategy_id, round(CAST(max(peak - cum) AS DOUBLE), 6) AS max_drawdown FROM p GROUP BY strategy_id""")


def period_sql(unit: str) -> str:
    return f"""ends AS (SELECT instrument, date_trunc('{unit}', ts)::TIMESTAMP AS p, max_by(equity, (epoch_us(ts)::HUGEINT * 10000000000 + seq)) AS e FROM equity GROUP BY ALL),
 rets AS (SELECT *, coalesce((e - lag(e, 1, 100000) OVER (PARTITION BY instrument ORDER BY p)) / nullif(lag(e, 1, 100000) OVER (PARTITION BY instrument ORDER BY p), 0), 0) AS r FROM ends)"""


def period_rows(df: DataFrame) -> DataFrame:
    return df.select("instrument", F.unix_micros(F.col("period").cast("timestamp")).alias("period_us"), r6("equity"), r6("return_pct"))


PERIOD_ROWS = "SELECT instrument, epoch_us(p) AS period_us, round(e, 6) AS equity, round(r, 6) AS return_pct FROM rets"
for name, unit, fn in (("eq_daily", "day", P.daily_returns), ("eq_monthly", "month", P.monthly_returns), ("eq_annual", "year", P.annual_returns)):
    R.add(name, lambda s, d, fn=fn: period_rows(fn(equity(s, d, layout_of(s, d)), ["instrument"], INITIAL_CASH)), f"WITH {EQUITY_SQL}, {period_sql(unit)} {PERIOD_ROWS}")
FALL_SQL = """fall AS (SELECT instrument, equity, greatest(max(equity) OVER (PARTITION BY instrument ORDER BY ts, seq), 0) AS peak FROM equity),
 dd AS (SELECT instrument, greatest(coalesce(max((peak - equity) / nullif(peak, 0)), 0), 0) AS v FROM fall GROUP BY instrument)"""
R.add("eq_max_drawdown_pct", lambda s, d: P.max_drawdown_pct(equity(s, d, layout_of(s, d)), ["instrument"], layout=layout_of(s, d)).select("instrument", r6("max_drawdown_pct")),
      f"WITH {EQUITY_SQL}, {FALL_SQL} SELECT instrument, round(v, 6) AS max_drawdown_pct FROM dd")
R.add("eq_report",
      lambda s, d: P.equity_report(equity(s, d, layout_of(s, d)), ["instrument"], INITIAL_CASH, layout=layout_of(s, d)).select(
          "instrument", r6("net_return_pct"), r6("average_daily_return_pct"), "positive_days", "negative_days", "flat_days", r6("max_drawdown_pct"),
          F.size("monthly_returns").cast("long").alias("months"), F.size("annual_returns").cast("long").alias("years")),
      f"""WITH {EQUITY_SQL}, {FALL_SQL}, {period_sql('day')},
 last AS (SELECT instrument, max_by(equity, (epoch_us(ts)::HUGEINT * 10000000000 + seq)) / 100000 - 1 AS net,
   count(DISTINCT date_trunc('month', ts)) AS months, count(DISTINCT date_trunc('year', ts)) AS years FROM equity GROUP BY instrument)
 SELECT instrument, round(any_value(net), 6) AS net_return_pct, round(avg(r), 6) AS average_daily_return_pct, count(*) FILTER (r > 0) AS positive_days,
  count(*) FILTER (r < 0) AS negative_days, count(*) FILTER (r = 0) AS flat_days, round(any_value(v), 6) AS max_drawdown_pct,
  any_value(months) AS months, any_value(years) AS years
 FROM rets JOIN last USING (instrument) JOIN dd USING (instrument) GROUP BY instrument""")

# --- selection ------------------------------------------------------------------------------
LIMITS = J.Thresholds(max_drawdown=150_000.0, min_profit_factor=0.95)
METRICS = ("win_rate", "net_pnl", "profit_factor", "expectancy", "max_drawdown")


def layout_of(spark: SparkSession, sf_dir: str) -> str:
    """One size check for the whole selection chain: no later table has more rows per instrument
    than there are orders of its customers."""
    return measured_layout(load(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("k")), ["k"])


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Trades feed both the running statistics and the list of evaluations.
    t = stable(closed_trades(spark, sf_dir))
    return J.metrics_as_of(evaluations(t), t, layout_of(spark, sf_dir))


METRICS_SQL = f"""{EVALUATIONS_SQL},
 path AS (
  SELECT *, sum(pnl_net) OVER (PARTITION BY instrument, strategy_id ORDER BY closed_at, position_id) AS cum FROM trades),
 falls AS (SELECT *, greatest(max(cum) OVER (PARTITION BY instrument, strategy_id ORDER BY closed_at, position_id), 0) - cum AS fall FROM path),
 seen AS (
  SELECT e.instrument, e.strategy_id, e.as_of, count(position_id) AS n, count(*) FILTER (pnl_net > 0) AS w, count(*) FILTER (pnl_net < 0) AS l,
   coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0)::DOUBLE AS won, coalesce(-sum(pnl_net) FILTER (pnl_net < 0), 0)::DOUBLE AS lost,
   coalesce(sum(pnl_net), 0)::DOUBLE AS net_pnl, coalesce(max(fall), 0)::DOUBLE AS max_drawdown
  FROM evaluations e LEFT JOIN falls t ON t.instrument = e.instrument AND t.strategy_id = e.strategy_id AND t.closed_at <= e.as_of GROUP BY ALL),
 metrics AS (
  SELECT instrument, strategy_id, as_of, n AS trades, coalesce(w::DOUBLE / nullif(n, 0), 0) AS win_rate, net_pnl, won / nullif(lost, 0) AS profit_factor,
   coalesce(w::DOUBLE / nullif(n, 0), 0) * coalesce(won / nullif(w, 0), 0) - (1 - coalesce(w::DOUBLE / nullif(n, 0), 0)) * coalesce(lost / nullif(l, 0), 0) AS expectancy,
   max_drawdown FROM seen)"""
CLASSIFIED_SQL = f"""{METRICS_SQL},
 fails AS (SELECT *, expectancy <= 0 AS f0, coalesce(profit_factor < {LIMITS.min_profit_factor}, false) AS f1, max_drawdown > {LIMITS.max_drawdown} AS f2, win_rate < 0.35 AS f3 FROM metrics),
 classified AS (
  SELECT *, CASE WHEN trades < 10 THEN 'disabled' WHEN f0 THEN 'disabled' WHEN f1::INT + f2::INT + f3::INT = 0 THEN 'active'
    WHEN f1::INT + f2::INT + f3::INT = 1 THEN 'degraded' ELSE 'disabled' END AS state,
   CASE WHEN trades < 10 THEN 'insufficient_sample' WHEN f0 THEN 'non_positive_expectancy' WHEN f1 THEN 'below_profit_factor_threshold'
    WHEN f2 THEN 'excessive_drawdown' WHEN f3 THEN 'below_consistency_threshold' ELSE 'meets_all_thresholds' END AS reason FROM fails)"""
HELD_SQL = f"""{CLASSIFIED_SQL},
 numbered AS (SELECT *, row_number() OVER (PARTITION BY instrument, strategy_id ORDER BY as_of) AS k FROM classified),
 machine AS (
  SELECT instrument, strategy_id, k, state AS held, CAST(NULL AS VARCHAR) AS pend, 0 AS c FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.instrument, n.strategy_id, n.k,
   CASE WHEN n.state = m.held THEN m.held WHEN (CASE WHEN m.pend = n.state THEN m.c + 1 ELSE 1 END) >= 3 THEN n.state ELSE m.held END,
   CASE WHEN n.state = m.held OR (CASE WHEN m.pend = n.state THEN m.c + 1 ELSE 1 END) >= 3 THEN NULL ELSE n.state END,
   CASE WHEN n.state = m.held OR (CASE WHEN m.pend = n.state THEN m.c + 1 ELSE 1 END) >= 3 THEN 0 WHEN m.pend = n.state THEN m.c + 1 ELSE 1 END
  FROM machine m JOIN numbered n ON n.instrument = m.instrument AND n.strategy_id = m.strategy_id AND n.k = m.k + 1),
 held AS (
  SELECT n.* EXCLUDE (state, reason), n.state AS proposed_state, m.held AS state, m.c AS confirmations,
   CASE WHEN m.c > 0 THEN 'transition_pending' ELSE n.reason END AS reason FROM numbered n JOIN machine m USING (instrument, strategy_id, k))"""
PAIR = Columns("instrument", "strategy_id", "as_of_us")
PAIR_SQL = "instrument, strategy_id, epoch_us(as_of) AS as_of_us"
R.add("judge_metrics_asof", lambda s, d: metrics(s, d).select(*PAIR, "trades", *[r6(c) for c in METRICS]),
      f"WITH {METRICS_SQL} SELECT {PAIR_SQL}, trades, {', '.join(f'round({c}, 6) AS {c}' for c in METRICS)} FROM metrics")
R.add("judge_classify", lambda s, d: J.classify(metrics(s, d), LIMITS).select(*PAIR, "state", "reason"),
      f"WITH {CLASSIFIED_SQL} SELECT {PAIR_SQL}, state, reason FROM classified")


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.held_states(J.classify(metrics(spark, sf_dir), LIMITS), LIMITS, layout_of(spark, sf_dir))


R.add("judge_state_hysteresis", lambda s, d: held(s, d).select(*PAIR, "proposed_state", "state", "reason", F.col("confirmations").cast("long").alias("confirmations")),
      f"WITH RECURSIVE {HELD_SQL} SELECT {PAIR_SQL}, proposed_state, state, reason, CAST(confirmations AS BIGINT) AS confirmations FROM held")

# The regime of a context at an evaluation follows from how many trades it has seen.
REGIMES = ("trending", "ranging", "volatility_expansion", "uncertain")
AFFINITY_SQL = "affinity(regime, kind, fit) AS (VALUES " + ", ".join(
    f"('{r}', '{k}', {v}::DOUBLE)" for r, kinds in J.AFFINITY.items() for k, v in kinds.items()) + ")"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = held(spark, sf_dir)
    seen = states.groupBy("instrument", "as_of").agg((F.sum("trades") % 7).alias("_n"))
    regime = F.when(F.col("_n") < 2, REGIMES[0]).when(F.col("_n") < 4, REGIMES[1]).when(F.col("_n") < 6, REGIMES[2]).otherwise(REGIMES[3])
    full = states.join(seen, ["instrument", "as_of"]).withColumn("regime", regime).drop("_n").withColumn("context", F.col("instrument"))
    return J.with_affinity(full).withColumn("candidate", F.col("strategy_id"))


CANDIDATES_SQL = f"""{HELD_SQL}, {AFFINITY_SQL},
 regimes AS (SELECT instrument, as_of, CAST(sum(trades) AS BIGINT) % 7 AS g FROM held GROUP BY ALL),
 candidates AS (
  SELECT h.*, h.instrument AS context, CASE WHEN g < 2 THEN 'trending' WHEN g < 4 THEN 'ranging' WHEN g < 6 THEN 'volatility_expansion' ELSE 'uncertain' END AS regime,
   coalesce(fit, 0.4) AS fit_score, h.reason = 'insufficient_sample' AS boot, NOT (h.state = 'disabled' AND h.reason <> 'insufficient_sample') AS eligible
  FROM held h JOIN regimes r ON r.instrument = h.instrument AND r.as_of = h.as_of
  LEFT JOIN affinity a ON a.regime = CASE WHEN g < 2 THEN 'trending' WHEN g < 4 THEN 'ranging' WHEN g < 6 THEN 'volatility_expansion' ELSE 'uncertain' END
   AND a.kind = split_part(h.strategy_id, '::', -1))"""
ECONOMIC = "CASE state WHEN 'active' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END DESC, expectancy DESC, (profit_factor IS NULL) DESC, profit_factor DESC, max_drawdown ASC, net_pnl DESC"
SELECTED_SQL = f"""{CANDIDATES_SQL},
 ranked AS (
  SELECT *, row_number() OVER (PARTITION BY context, as_of ORDER BY fit_score DESC, {ECONOMIC}, strategy_id DESC) AS clear_rank,
   row_number() OVER (PARTITION BY context, as_of ORDER BY {ECONOMIC}, fit_score DESC, strategy_id DESC) AS unclear_rank FROM candidates WHERE eligible),
 winner AS (SELECT * FROM ranked WHERE CASE WHEN regime = 'uncertain' THEN unclear_rank ELSE clear_rank END = 1),
 slots AS (SELECT context, as_of, any_value(regime) AS regime, bool_and(boot) AS all_bootstrap FROM candidates GROUP BY ALL),
 proposals AS (
  SELECT s.context, s.as_of, s.regime, s.all_bootstrap, w.strategy_id AS proposed, w.fit_score, coalesce(w.boot, false) AS bootstrap,
   CASE WHEN w.strategy_id IS NULL THEN 'no_viable_candidate' WHEN s.regime = 'uncertain' THEN 'economic_fallback' WHEN w.boot THEN 'regime_bootstrap' ELSE 'regime_fit' END AS selection_reason
  FROM slots s LEFT JOIN winner w USING (context, as_of))"""
PENDING = "(CASE WHEN m.c > 0 AND m.pend IS NOT DISTINCT FROM n.proposed THEN m.c + 1 ELSE 1 END)"
DIRECT = "(n.regime = 'uncertain' OR (m.held IS NULL AND m.c = 0) OR n.proposed IS NOT DISTINCT FROM m.held)"
SELECTION_SQL = f"""{SELECTED_SQL},
 steps AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY as_of) AS k FROM proposals),
 chooser AS (
  SELECT context, k, proposed AS held, CAST(NULL AS VARCHAR) AS pend, 0 AS c FROM steps WHERE k = 1
  UNION ALL
  SELECT n.context, n.k, CASE WHEN {DIRECT} OR {PENDING} >= 3 THEN n.proposed ELSE m.held END,
   CASE WHEN {DIRECT} OR {PENDING} >= 3 THEN NULL ELSE n.proposed END, CASE WHEN {DIRECT} OR {PENDING} >= 3 THEN 0 ELSE {PENDING} END
  FROM chooser m JOIN steps n ON n.context = m.context AND n.k = m.k + 1),
 selections AS (
  SELECT s.* EXCLUDE (selection_reason), c.held AS selected, c.c AS waiting, CASE WHEN c.c > 0 THEN 'selection_pending' ELSE s.selection_reason END AS selection_reason
  FROM steps s JOIN chooser c USING (context, k))"""
SLOT = Columns("context", "as_of_us")
R.add("regime_affinity", lambda s, d: candidates(s, d).select("context", "strategy_id", us("as_of"), "regime", r6("fit_score")),
      f"WITH RECURSIVE {CANDIDATES_SQL} SELECT context, strategy_id, epoch_us(as_of) AS as_of_us, regime, round(fit_score, 6) AS fit_score FROM candidates")
R.add("judge_select", lambda s, d: J.select_strategy(candidates(s, d)).select(*SLOT, "regime", "proposed", "bootstrap", "selection_reason"),
      f"WITH RECURSIVE {SELECTED_SQL} SELECT context, epoch_us(as_of) AS as_of_us, regime, proposed, bootstrap, selection_reason FROM proposals")


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.held_selection(J.select_strategy(candidates(spark, sf_dir)), layout=layout_of(spark, sf_dir))


R.add("judge_select_hysteresis", lambda s, d: selections(s, d).select(*SLOT, "proposed", "selected", F.col("waiting").cast("long").alias("waiting"), "selection_reason"),
      f"WITH RECURSIVE {SELECTION_SQL} SELECT context, epoch_us(as_of) AS as_of_us, proposed, selected, CAST(waiting AS BIGINT) AS waiting, selection_reason FROM selections")
R.add("judge_switches", lambda s, d: J.switches(selections(s, d), layout_of(s, d)).select(*SLOT, "previous", "selected"),
      f"""WITH RECURSIVE {SELECTION_SQL}, l AS (SELECT *, lag(selected) OVER (PARTITION BY context ORDER BY k) AS previous FROM selections)
 SELECT context, epoch_us(as_of) AS as_of_us, previous, selected FROM l WHERE k > 1 AND selected IS DISTINCT FROM previous""")


def to_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions opened in the latest month stand for the open ones."""
    t = closed_trades(spark, sf_dir)
    pairs = t.select(F.col("instrument").alias("context"), "instrument", "strategy_id").distinct()
    return J.positions_to_close(t.drop("as_of"), pairs, selections(spark, sf_dir)).filter("closed_at >= as_of").select("context", "position_id")


R.add("judge_positions_to_close", to_close,
      f"""WITH RECURSIVE {SELECTION_SQL}, latest AS (SELECT context, max_by(selected, k) AS selected, max(as_of) AS as_of FROM (SELECT context, k, as_of, coalesce(selected, '') AS selected FROM selections) GROUP BY context)
 SELECT context, position_id FROM trades JOIN latest ON context = instrument WHERE strategy_id <> selected AND closed_at >= as_of""")


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trade's opening is a long or short signal at its month's evaluation."""
    t = closed_trades(spark, sf_dir)
    month = F.date_trunc("month", F.col("opened_at")) + F.make_ym_interval(F.lit(0), F.lit(1))
    signals = t.select("position_id", F.col("instrument").alias("context"), month.alias("as_of"), "strategy_id",
                       F.when(F.col("pnl_gross") > 0, "long").otherwise("short").alias("direction"))
    own = candidates(spark, sf_dir)
    return J.gate_signals(signals, own, J.held_selection(J.select_strategy(own), layout=layout_of(spark, sf_dir))).select("position_id", "direction", "allowed")


R.add("signal_gate", gated,
      f"""WITH RECURSIVE {SELECTION_SQL},
 sig AS (SELECT position_id, instrument AS context, date_trunc('month', opened_at)::TIMESTAMP + INTERVAL 1 MONTH AS as_of, strategy_id,
   CASE WHEN pnl_gross > 0 THEN 'long' ELSE 'short' END AS direction FROM trades)
 SELECT position_id, direction, CASE WHEN direction <> 'long' THEN true WHEN s.selected IS NULL OR coalesce(l.boot, false) OR s.all_bootstrap THEN own.eligible
  ELSE s.selected = sig.strategy_id END AS allowed
 FROM sig JOIN selections s USING (context, as_of) JOIN candidates own ON own.context = sig.context AND own.as_of = sig.as_of AND own.strategy_id = sig.strategy_id
 LEFT JOIN candidates l ON l.context = sig.context AND l.as_of = sig.as_of AND l.strategy_id = s.selected""")


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = tape_layout(spark, sf_dir)
    f = X.feature_series(bars(spark, sf_dir, "1h"), recursive=False, layout=layout)
    return J.classify_regime(J.with_previous_bandwidth(f, layout=layout)).select("instrument", us("close_time"), "regime", r6("regime_strength"), "regime_rule")


from tickloom.plans.candle_queries import AC, LAGGED, M, R2, RV, SD, gated as gate_n  # noqa: E402

R.add("regime_classify", regimes,
      f"""WITH {bars_sql('1h')}{LAGGED}, f AS (SELECT instrument, close_s, rn, {gate_n(f"(close - {M} + 2 * {SD}) / nullif(4 * {SD}, 0)", 20)} AS b,
  {gate_n(f"4 * {SD} / nullif({M}, 0)", 20)} AS bw, {R2} AS r2, {RV} AS rv, {AC} AS ac FROM lagged),
 g AS (SELECT *, lag(bw) OVER (PARTITION BY instrument ORDER BY rn) AS pbw FROM f),
 c AS (SELECT *, CASE WHEN (b < 0 OR b > 1) AND bw > pbw AND rv >= 1.5 THEN 1 WHEN r2 >= 0.6 AND ac > 0.3 THEN 2 WHEN r2 <= 0.3 AND ac <= 0.3 THEN 3 WHEN r2 <= 0.3 AND ac IS NULL THEN 4 ELSE 5 END AS k FROM g)
 SELECT instrument, close_s * 1000000 AS close_time_us, CASE k WHEN 1 THEN 'volatility_expansion' WHEN 2 THEN 'trending' WHEN 5 THEN 'uncertain' ELSE 'ranging' END AS regime,
  CASE k WHEN 1 THEN 'breakout_expanding_bandwidth_volume' WHEN 2 THEN 'trend_r2_and_autocorr' WHEN 3 THEN 'low_r2_and_low_autocorr' WHEN 4 THEN 'low_r2_only' ELSE 'uncertain' END AS regime_rule,
  round(CASE k WHEN 1 THEN least(0.55::DOUBLE + CASE WHEN b > 1 THEN b - 1 ELSE -b END * 0.3::DOUBLE + least(greatest(rv - 1, 0), 1) * 0.15::DOUBLE, 1)
   WHEN 2 THEN greatest((r2 - 0.6::DOUBLE) / 0.4::DOUBLE * 0.5::DOUBLE + least(ac - 0.3::DOUBLE, 0.7) / 0.7::DOUBLE * 0.5::DOUBLE, 0.55)
   WHEN 3 THEN least(greatest(1 - r2, 0.4), 0.95) WHEN 4 THEN least(greatest(1 - r2, 0.35), 0.8) ELSE 0 END, 6) AS regime_strength FROM c""")
