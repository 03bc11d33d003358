"""Registered queries of candle tables, indicators and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import candles as C
from tickloom.operators import features as X
from tickloom.operators import signals as S
from tickloom.operators.reports import conform
from tickloom.operators.series import Recursion, recursions
from tickloom.plans.adapters import Columns, bars, bars_sql, r6, raw_tape, tape_layout, tape_rules, us
from tickloom.plans.registry import Registry

R = Registry()
KEY = Columns("instrument", "close_time_us")
SQL_KEY = "instrument, close_s * 1000000 AS close_time_us"


def sized(df: DataFrame) -> DataFrame:
    return df.select(
        "instrument", "timeframe", us("open_time"), us("close_time"),
        *[r6(c) for c in ("open", "high", "low", "close", "volume")],
    )


def ohlc_sql(where: str = "bars") -> str:
    return f"""SELECT instrument, timeframe, open_s * 1000000 AS open_time_us, close_s * 1000000 AS close_time_us,
 round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM {where}"""


def resample_sql(target: str, source: str = "bars", step: str = "15m") -> str:
    w, n = C.timeframe_seconds(target), C.timeframe_seconds(target) // C.timeframe_seconds(step)
    return f"""SELECT instrument, '{target}' AS timeframe, open_s // {w} * {w} AS open_s, open_s // {w} * {w} + {w} AS close_s,
 min_by(open, open_s) AS open, max(high) AS high, min(low) AS low, max_by(close, open_s) AS close, sum(volume) AS volume
 FROM {source} GROUP BY instrument, open_s // {w} HAVING count(*) = {n}"""


R.add("candles_from_trades", lambda s, d: sized(bars(s, d, "1h")), f"WITH {bars_sql('1h')} {ohlc_sql()}")
R.add("filter_closed", lambda s, d: sized(C.closed_only(bars(s, d, "15m").withColumn("is_closed", F.col("close") >= F.col("open")))),
      f"WITH {bars_sql('15m')} {ohlc_sql()} WHERE close >= open")
R.add("resample", lambda s, d: sized(C.resample(bars(s, d, "15m", pooled=True), "15m", "1h")),
      f"WITH {bars_sql('15m', pooled=True)}, coarse AS ({resample_sql('1h')}) {ohlc_sql('coarse')}")
R.add("derive_timeframes",
      lambda s, d: sized(C.derive_timeframes(bars(s, d, "15m", pooled=True), "15m", ("30m", "1h", "4h"))),
      f"WITH {bars_sql('15m', pooled=True)}, coarse AS ({' UNION ALL '.join(resample_sql(t) for t in ('30m', '1h', '4h'))}) {ohlc_sql('coarse')}")

# Arrival order for the checks: bars sorted by a scrambled clock, and every volatile bar sent twice.
def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir, "1h")
    o = F.unix_seconds("open_time")
    first = b.withColumn("seq", o * 4 + F.when(F.col("close") < F.col("open"), F.lit(3600 * 9)).otherwise(F.lit(0)))
    again = b.filter("high > low * 8").withColumn("seq", o * 4 + 2)
    return first.unionByName(again)


ARRIVALS_SQL = f"""{bars_sql('1h')},
 arrivals AS (
  SELECT *, open_s * 4 + CASE WHEN close < open THEN 32400 ELSE 0 END AS seq FROM bars
  UNION ALL SELECT *, open_s * 4 + 2 AS seq FROM bars WHERE high > low * 8),
 flagged AS (SELECT *, row_number() OVER (PARTITION BY instrument, open_s ORDER BY seq) > 1 AS dup FROM arrivals),
 seen AS (
  SELECT *, max(CASE WHEN NOT dup THEN open_s END) OVER (PARTITION BY instrument ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_open FROM flagged),
 audited AS (
  SELECT *, NOT dup AND coalesce(open_s <= prev_open, false) AS late,
   CASE WHEN NOT dup AND open_s > prev_open THEN (open_s - prev_open - 3600) // 3600 ELSE 0 END AS missing FROM seen)"""


def audited(spark, sf_dir):
    return C.audit(arrivals(spark, sf_dir), "1h", layout=tape_layout(spark, sf_dir))


def placed_rows(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("instrument", us("open_time"), "seq", *extra)


R.add("validate_duplicates", lambda s, d: placed_rows(C.duplicates(audited(s, d))),
      f"WITH {ARRIVALS_SQL} SELECT instrument, open_s * 1000000 AS open_time_us, seq FROM audited WHERE dup")
R.add("validate_out_of_order", lambda s, d: placed_rows(C.out_of_order(audited(s, d))),
      f"WITH {ARRIVALS_SQL} SELECT instrument, open_s * 1000000 AS open_time_us, seq FROM audited WHERE late")
R.add("validate_gaps", lambda s, d: placed_rows(C.gaps(audited(s, d)), "missing"),
      f"WITH {ARRIVALS_SQL} SELECT instrument, open_s * 1000000 AS open_time_us, seq, missing FROM audited WHERE missing > 0")
REPORT_SQL = """SELECT instrument, count(*) AS rows, count(*) FILTER (missing > 0) AS gap_count, CAST(sum(missing) AS BIGINT) AS total_missing,
 count(*) FILTER (dup) AS duplicate_count, count(*) FILTER (late) AS out_of_order_count,
 count(*) FILTER (missing > 0 OR dup OR late) = 0 AS is_clean FROM audited GROUP BY instrument"""
R.add("validation_report", lambda s, d: C.validation_report(audited(s, d)).drop("timeframe"), f"WITH {ARRIVALS_SQL} {REPORT_SQL}")


def gate(spark, sf_dir):
    """Pooled and per-type bars behind the strict gate: only complete series pass."""
    both = bars(spark, sf_dir, "1h").unionByName(bars(spark, sf_dir, "1h", pooled=True)).withColumn("seq", F.unix_seconds("open_time"))
    report = C.validation_report(C.audit(both, "1h", layout=tape_layout(spark, sf_dir, pooled=True)))
    kept, skipped = C.strict_gate(both, report)
    passed = kept.groupBy("instrument").agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("missing"))
    return passed.unionByName(skipped.select("instrument", "rows", F.col("total_missing").alias("missing")))


R.add("strict_gate", gate,
      f"""WITH {bars_sql('1h')}, pooled AS (SELECT DISTINCT 'all' AS instrument, open_s FROM bars),
 both_sets AS (SELECT instrument, open_s FROM bars UNION ALL SELECT * FROM pooled)
 SELECT instrument, count(*) AS rows, (max(open_s) - min(open_s)) // 3600 + 1 - count(*) AS missing FROM both_sets GROUP BY instrument""")


def cut_times(spark, sf_dir):
    """The middle of the bars' time, at a full day, and the day before: where the stored part ends and the fetch begins."""
    ends = bars(spark, sf_dir, "1h").agg(F.unix_seconds(F.min("open_time")), F.unix_seconds(F.max("open_time"))).first()
    cut = ((ends[0] or 0) + (ends[1] or 0)) // 2 // 86400 * 86400
    return F.timestamp_seconds(F.lit(cut)), F.timestamp_seconds(F.lit(cut - 86400))


def merged(spark, sf_dir):
    """Existing bars end at the series' middle; the fetch overlaps them with changed volumes."""
    b, (cut, overlap) = bars(spark, sf_dir, "1h"), cut_times(spark, sf_dir)
    existing = b.filter(F.col("open_time") < cut)
    fetched = b.filter(F.col("open_time") >= overlap).withColumn("volume", (F.col("volume") + 1).cast("decimal(18,8)"))
    return C.merge_incremental(existing, fetched)


CUT_SQL = "(SELECT (min(open_s) + max(open_s)) // 2 // 86400 * 86400 FROM bars)"
MERGED_SQL = f"""{bars_sql('1h')}, merged AS (
 SELECT * REPLACE (CASE WHEN open_s < {CUT_SQL} THEN volume ELSE volume + 1 END AS volume), open_s >= {CUT_SQL} AS is_new FROM bars)"""
R.add("incremental_merge", lambda s, d: sized(merged(s, d)), f"WITH {MERGED_SQL} {ohlc_sql('merged')}")
R.add("incremental_high_water",
      lambda s, d: sized(C.fetch_since(bars(s, d, "1h"), C.high_water_mark(bars(s, d, "1h").filter(F.col("open_time") < cut_times(s, d)[0])))),
      f"""WITH {bars_sql('1h')}, marks AS (SELECT instrument, max(close_s) AS m FROM bars WHERE open_s < {CUT_SQL} GROUP BY instrument),
 late AS (SELECT bars.* FROM bars LEFT JOIN marks USING (instrument) WHERE open_s >= coalesce(m, 1483228800)) {ohlc_sql('late')}""")
R.add("update_summary",
      lambda s, d: C.update_summary(merged(s, d)).select("instrument", "candles_before", "candles_after", "candles_new", us("earliest"), us("latest")),
      f"""WITH {MERGED_SQL} SELECT instrument, count(*) FILTER (NOT is_new) AS candles_before, count(*) AS candles_after,
 count(*) FILTER (is_new) AS candles_new, min(open_s) * 1000000 AS earliest_us, max(close_s) * 1000000 AS latest_us FROM merged GROUP BY instrument""")


def refused(spark, sf_dir):
    """What the market rules keep out of the tape that all candle queries read, by instrument and rule."""
    good, bad = conform(raw_tape(spark, sf_dir), tape_rules())
    return good.select("instrument", F.lit("").alias("violations")).unionByName(bad.select("instrument", F.concat_ws(",", "violations").alias("violations"))).groupBy("instrument", "violations").agg(F.count(F.lit(1)).alias("n"))


R.add("tape_quarantine", refused,
      """SELECT event_type AS instrument, concat_ws(',', CASE WHEN NOT coalesce(value > 0, false) THEN 'price' END,
 CASE WHEN NOT coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0, false) THEN 'quantity' END, CASE WHEN ts IS NULL THEN 'ts' END) AS violations, count(*) AS n FROM events GROUP BY ALL""")
# Daily order totals span several years, so every look-back window differs.
def daily(spark, sf_dir):
    from tickloom.plans.adapters import load

    o = load(spark, sf_dir, "orders")
    t = o.select(F.col("o_orderpriority").alias("instrument"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("trade_id"),
                 F.col("o_totalprice").cast("decimal(18,8)").alias("price"), F.lit(1).cast("decimal(18,8)").alias("quantity"))
    return C.candles_from_trades(t, "1d")


DAILY_SQL = """daily AS (
 SELECT o_orderpriority AS instrument, epoch_us(o_orderdate) // 86400000000 * 86400 AS open_s, open_s + 86400 AS close_s,
  max_by(o_totalprice, o_orderkey) AS close, count(*) AS n FROM orders GROUP BY ALL)"""
R.add("recent_window",
      lambda s, d: C.recent_windows(daily(s, d)).groupBy("instrument", "window").agg(
          F.count(F.lit(1)).alias("bars"), F.min(F.unix_micros("open_time")).alias("first_open_us")),
      f"""WITH {DAILY_SQL}, ends AS (SELECT instrument, max(close_s) AS e FROM daily GROUP BY instrument),
 w(name, m) AS (VALUES ('full', NULL), ('24m', 24), ('12m', 12), ('6m', 6), ('3m', 3))
 SELECT instrument, name AS "window", count(*) AS bars, min(open_s) * 1000000 AS first_open_us
 FROM daily JOIN ends USING (instrument) CROSS JOIN w
 WHERE m IS NULL OR make_timestamp(open_s * 1000000) >= make_timestamp(e * 1000000) - to_months(CAST(m AS INTEGER)) GROUP BY ALL""")
R.add("buy_and_hold", lambda s, d: C.buy_and_hold(bars(s, d, "1h")).select("instrument", r6("benchmark_return")),
      f"WITH {bars_sql('1h')} SELECT instrument, round(max_by(close, open_s) / min_by(close, open_s) - 1, 6) AS benchmark_return FROM bars GROUP BY instrument")


# --- indicators -----------------------------------------------------------------------------
W = "OVER (PARTITION BY instrument ORDER BY rn)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY instrument ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gated(expr: str, n: int, col: str = "close") -> str:
    return f"CASE WHEN count({col}) {frame(n)} = {n} THEN {expr} END"


def feature_query(*columns: str):
    """Column pruning keeps only the frames these columns need."""
    recursive = bool({"ema", "atr", "rsi", "ewma_volatility"} & set(columns))
    return lambda s, d: X.feature_series(bars(s, d, "1h"), recursive=recursive, layout=tape_layout(s, d)).select(*KEY, *[r6(c) for c in columns])


def feature_sql(*exprs: str, ctes: str = "", source: str = "bars") -> str:
    return f"WITH {bars_sql('1h')}{ctes} SELECT {SQL_KEY}, {', '.join(exprs)} FROM {source}"


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


R.add("rolling_window",
      lambda s, d: X.indicator(bars(s, d, "1h"), lambda df, w: df.withColumns(X.rolling_stats(F.col("close"), w, 20)), reach=20, layout=tape_layout(s, d)).select(
          *KEY, *[r6(f"roll_{c}") for c in ("sum", "mean", "stddev", "first", "last")]),
      feature_sql(r(f"sum(close) {frame(20)}", "roll_sum"), r(f"avg(close) {frame(20)}", "roll_mean"), r(f"stddev_pop(close) {frame(20)}", "roll_stddev"),
                  r(f"first_value(close) {frame(20)}", "roll_first"), r(f"last_value(close) {frame(20)}", "roll_last")))
R.add("feat_returns", feature_query("ret_1", "ret_5", "ret_15", "ret_60"),
      feature_sql(*[r(f"close / nullif(lag(close, {p}) {W}, 0) - 1", f"ret_{p}") for p in (1, 5, 15, 60)]))
R.add("feat_sma", feature_query("sma"), feature_sql(r(gated(f"avg(close) {frame(20)}", 20), "sma")))
R.add("feat_stddev", feature_query("stddev"), feature_sql(r(gated(f"stddev_pop(close) {frame(20)}", 20), "stddev")))
Z = gated(f"(close - avg(close) {frame(20)}) / nullif(stddev_pop(close) {frame(20)}, 0)", 20)
R.add("feat_zscore", feature_query("zscore"), feature_sql(r(Z, "zscore")))
M, SD = f"avg(close) {frame(20)}", f"stddev_pop(close) {frame(20)}"
R.add("feat_bollinger", feature_query("bb_middle", "bb_upper", "bb_lower", "percent_b", "bandwidth"),
      feature_sql(r(gated(M, 20), "bb_middle"), r(gated(f"{M} + 2 * {SD}", 20), "bb_upper"), r(gated(f"{M} - 2 * {SD}", 20), "bb_lower"),
                  r(gated(f"(close - {M} + 2 * {SD}) / nullif(4 * {SD}, 0)", 20), "percent_b"), r(gated(f"4 * {SD} / nullif({M}, 0)", 20), "bandwidth")))
R.add("feat_roc", feature_query("roc"), feature_sql(r(f"(close / nullif(lag(close, 12) {W}, 0) - 1) * 100", "roc")))
R.add("feat_relative_volume", feature_query("relative_volume"),
      feature_sql(r(gated(f"volume / nullif(avg(volume) {frame(20)}, 0)", 20, "volume"), "relative_volume")))
R.add("feat_regression", feature_query("reg_slope", "reg_intercept", "reg_r2"),
      feature_sql(r(gated(f"regr_slope(close, rn) {frame(20)}", 20), "reg_slope"),
                  r(gated(f"avg(close) {frame(20)} - regr_slope(close, rn) {frame(20)} * 9.5::DOUBLE", 20), "reg_intercept"),
                  r(gated(f"CASE WHEN stddev_pop(close) {frame(20)} > 0 THEN regr_r2(close, rn) {frame(20)} END", 20), "reg_r2")))
LR = f""", lr AS (SELECT *, ln(close / lag(close) {W}) AS lr FROM bars)"""
LAGGED = LR + f", lagged AS (SELECT *, lag(lr) {W} AS plr FROM lr)"
R.add("feat_realized_vol", feature_query("realized_volatility"),
      feature_sql(r(gated(f"stddev_pop(lr) {frame(20)}", 20, "lr"), "realized_volatility"), ctes=LR, source="lr"))
AC = gated(f"covar_pop(lr, plr) {frame(19)} / nullif(stddev_pop(lr) {frame(19)} * stddev_pop(plr) {frame(19)}, 0)", 20, "lr")
R.add("feat_autocorr", feature_query("autocorrelation"), feature_sql(r(AC, "autocorrelation"), ctes=LAGGED, source="lagged"))


def scan_sql(name: str, x: str, alpha: float, source: str, start: int = 1, seed: int = 1) -> str:
    """One-row-at-a-time recursion, the independent form of the block scan."""
    first = start + seed - 1
    return f"""{name}_x AS (SELECT instrument, rn, CAST({x} AS DOUBLE) AS x FROM {source}),
 {name} AS (
  SELECT instrument, {first}::BIGINT AS rn, avg(x) AS v FROM {name}_x WHERE rn BETWEEN {start} AND {first} GROUP BY instrument HAVING count(*) = {seed}
  UNION ALL
  SELECT t.instrument, t.rn, s.v + {alpha!r}::DOUBLE * (t.x - s.v) FROM {name} s JOIN {name}_x t ON t.instrument = s.instrument AND t.rn = s.rn + 1)"""


PREV = f"""prev AS (SELECT *, lag(close) {W} AS pc FROM bars)"""
SCANS = {
    "ema": scan_sql("ema", "close", 2 / 21, "bars"),
    "atr": scan_sql("atr", "greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0))", 1 / 14, "prev", 1, 14),
    "gain": scan_sql("gain", "greatest(close - pc, 0)", 1 / 14, "prev", 2, 14),
    "loss": scan_sql("loss", "greatest(pc - close, 0)", 1 / 14, "prev", 2, 14),
    "variance": scan_sql("variance", "ln(close / pc) * ln(close / pc)", 0.06, "prev", 2, 1),
}


def scanned_sql(names: list[str], exprs: list[str]) -> str:
    joins = " ".join(f"LEFT JOIN {n} ON {n}.instrument = prev.instrument AND {n}.rn = prev.rn" for n in names)
    return (f"WITH RECURSIVE {bars_sql('1h')}, {PREV}, {', '.join(SCANS[n] for n in names)} "
            f"SELECT prev.instrument, close_s * 1000000 AS close_time_us, {', '.join(exprs)} FROM prev {joins}")


RSI = "CASE WHEN gain.v = 0 AND loss.v = 0 THEN 50 WHEN loss.v = 0 THEN 100 ELSE 100 - 100 / (1 + gain.v / loss.v) END"
R.add("feat_ema", feature_query("ema"), scanned_sql(["ema"], [r("ema.v", "ema")]))
R.add("feat_atr", feature_query("atr"), scanned_sql(["atr"], [r("atr.v", "atr")]))
R.add("feat_rsi", feature_query("rsi"), scanned_sql(["gain", "loss"], [r(RSI, "rsi")]))
R.add("feat_ewma_vol", feature_query("ewma_volatility"), scanned_sql(["variance"], [r("sqrt(variance.v)", "ewma_volatility")]))
R.add("wilder_average",
      lambda s, d: recursions(X.as_doubles(bars(s, d, "1h")), X.KEYS, X.ORDER, {"wilder": Recursion(F.col("volume"), 1 / 14, seed_rows=14)}, tape_layout(s, d)).select(*KEY, r6("wilder")),
      f"WITH RECURSIVE {bars_sql('1h')}, {scan_sql('wilder', 'volume', 1 / 14, 'bars', 1, 14)} SELECT bars.instrument, close_s * 1000000 AS close_time_us, round(wilder.v, 6) AS wilder FROM bars LEFT JOIN wilder USING (instrument, rn)")
R.add("affine_scan",
      lambda s, d: recursions(X.as_doubles(bars(s, d, "1h")), X.KEYS, X.ORDER, {"fast": X.ema(F.col("close"), 12), "slow": X.ema(F.col("close"), 26)},
                              layout="blocks", span=64).select(*KEY, r6("fast"), r6("slow")),
      f"WITH RECURSIVE {bars_sql('1h')}, {scan_sql('fast', 'close', 2 / 13, 'bars')}, {scan_sql('slow', 'close', 2 / 27, 'bars')} "
      "SELECT bars.instrument, close_s * 1000000 AS close_time_us, round(fast.v, 6) AS fast, round(slow.v, 6) AS slow FROM bars JOIN fast USING (instrument, rn) JOIN slow USING (instrument, rn)")

# Every family on one row; the check holds one window and one recursion column of each shape.
R.add("feature_snapshot", feature_query("sma", "zscore", "percent_b", "reg_r2", "rsi", "atr"),
      f"""WITH RECURSIVE {bars_sql('1h')}, {PREV}, {SCANS['gain']}, {SCANS['loss']}, {SCANS['atr']}
 SELECT prev.instrument, close_s * 1000000 AS close_time_us, {r(gated(M, 20).replace('instrument', 'prev.instrument').replace('rn', 'prev.rn'), 'sma')},
 {r(Z.replace('instrument', 'prev.instrument').replace('rn', 'prev.rn'), 'zscore')},
 {r(gated(f"(close - {M} + 2 * {SD}) / nullif(4 * {SD}, 0)", 20).replace('instrument', 'prev.instrument').replace('rn', 'prev.rn'), 'percent_b')},
 {r(gated(f"CASE WHEN stddev_pop(close) {frame(20)} > 0 THEN regr_r2(close, rn) {frame(20)} END", 20).replace('instrument', 'prev.instrument').replace('rn', 'prev.rn'), 'reg_r2')},
 {r(RSI, 'rsi')}, {r('atr.v', 'atr')}
 FROM prev LEFT JOIN gain ON gain.instrument = prev.instrument AND gain.rn = prev.rn
 LEFT JOIN loss ON loss.instrument = prev.instrument AND loss.rn = prev.rn LEFT JOIN atr ON atr.instrument = prev.instrument AND atr.rn = prev.rn""")
R.add("feature_series", lambda s, d: X.feature_series(bars(s, d, "1h"), layout=tape_layout(s, d)).groupBy("instrument").agg(
      F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for c in ("ret_60", "sma", "rsi", "atr", "autocorrelation", "ewma_volatility")]),
      f"""WITH {bars_sql('1h')}, n AS (SELECT instrument, count(*) AS rows FROM bars GROUP BY instrument)
 SELECT instrument, rows, greatest(rows - 60, 0) AS n_ret_60, greatest(rows - 19, 0) AS n_sma, greatest(rows - 14, 0) AS n_rsi,
 greatest(rows - 13, 0) AS n_atr, greatest(rows - 20, 0) AS n_autocorrelation, greatest(rows - 1, 0) AS n_ewma_volatility FROM n""")


# --- signals --------------------------------------------------------------------------------
def signal_rows(df: DataFrame) -> DataFrame:
    return S.emitted(df).select("instrument", us("ts"), "direction", r6("confidence"))


def candidate_rows(df: DataFrame) -> DataFrame:
    return df.select("instrument", us("ts"), "entry", r6(F.when(F.col("entry").isNotNull(), F.col("confidence")), "confidence"), "exit_long")


def baseline(fn):
    return lambda s, d: signal_rows(fn(bars(s, d, "1h"), layout=tape_layout(s, d)))


def quantitative(fn, recursive: bool = False):
    def query(s: SparkSession, d: str) -> DataFrame:
        layout = tape_layout(s, d)
        return candidate_rows(fn(X.feature_series(bars(s, d, "1h"), recursive=recursive, layout=layout), layout=layout))

    return query


MR_SQL = f""", mr AS (SELECT *, {Z} AS z FROM bars)"""
R.add("strat_mean_reversion", baseline(S.mean_reversion),
      f"WITH {bars_sql('1h')}{MR_SQL} SELECT instrument, close_s * 1000000 AS ts_us, CASE WHEN z > 0 THEN 'short' ELSE 'long' END AS direction, round(least(abs(z) / 4, 1), 6) AS confidence FROM mr WHERE abs(z) >= 2")
R.add("strat_momentum", baseline(S.momentum),
      f"""WITH {bars_sql('1h')}, m AS (SELECT *, {gated(f'close / first_value(close) {frame(10)} - 1', 10)} AS x FROM bars)
 SELECT instrument, close_s * 1000000 AS ts_us, CASE WHEN x > 0 THEN 'long' ELSE 'short' END AS direction, round(least(abs(x) / 0.05::DOUBLE, 1), 6) AS confidence FROM m WHERE abs(x) >= 0.01""")
R.add("strat_ema_crossover", baseline(S.ema_crossover),
      f"""WITH RECURSIVE {bars_sql('1h')}, {scan_sql('fast', 'close', 2 / 13, 'bars')}, {scan_sql('slow', 'close', 2 / 27, 'bars')},
 d AS (SELECT bars.instrument, close_s, bars.rn, fast.v - slow.v AS diff, slow.v AS slow FROM bars JOIN fast USING (instrument, rn) JOIN slow USING (instrument, rn)),
 p AS (SELECT *, lag(diff) {W} AS pd FROM d)
 SELECT instrument, close_s * 1000000 AS ts_us, CASE WHEN diff > 0 THEN 'long' ELSE 'short' END AS direction, round(least(abs(diff) / abs(slow), 1), 6) AS confidence
 FROM p WHERE (pd <= 0 AND diff > 0) OR (pd >= 0 AND diff < 0)""")
R.add("strat_stat_mean_reversion", quantitative(S.statistical_mean_reversion, recursive=True),
      f"""WITH RECURSIVE {bars_sql('1h')}, {PREV}, {SCANS['gain']}, {SCANS['loss']}{LAGGED},
 f AS (SELECT lagged.instrument, close_s, {Z.replace('instrument', 'lagged.instrument').replace('rn', 'lagged.rn')} AS z,
   {AC.replace('instrument', 'lagged.instrument').replace('rn', 'lagged.rn')} AS ac, {RSI} AS rsi
  FROM lagged LEFT JOIN gain ON gain.instrument = lagged.instrument AND gain.rn = lagged.rn LEFT JOIN loss ON loss.instrument = lagged.instrument AND loss.rn = lagged.rn),
 e AS (SELECT *, CASE WHEN ac <= 0.3 AND z >= 2 AND rsi >= 70 THEN 'short' WHEN ac <= 0.3 AND z <= -2 AND rsi <= 30 THEN 'long' END AS entry FROM f)
 SELECT instrument, close_s * 1000000 AS ts_us, entry, CASE WHEN entry IS NOT NULL THEN round(least(abs(z) / 4, 1), 6) END AS confidence,
 z IS NULL OR abs(z) <= 0.5 AS exit_long FROM e""")
R2 = gated(f"CASE WHEN stddev_pop(close) {frame(20)} > 0 THEN regr_r2(close, rn) {frame(20)} END", 20)
RV = gated(f"volume / nullif(avg(volume) {frame(20)}, 0)", 20, "volume")
R.add("strat_quant_momentum", quantitative(S.quant_momentum),
      f"""WITH {bars_sql('1h')}, f AS (SELECT instrument, close_s, {R2} AS r2, {gated(f'regr_slope(close, rn) {frame(20)}', 20)} AS slope, {RV} AS rv FROM bars),
 e AS (SELECT *, CASE WHEN r2 >= 0.6 AND rv >= 1 AND slope > 0 THEN 'long' WHEN r2 >= 0.6 AND rv >= 1 AND slope < 0 THEN 'short' END AS entry FROM f)
 SELECT instrument, close_s * 1000000 AS ts_us, entry, CASE WHEN entry IS NOT NULL THEN round(least(r2, 1), 6) END AS confidence, r2 IS NULL OR r2 < 0.3 OR slope <= 0 AS exit_long FROM e""")
R.add("strat_volatility_breakout", quantitative(S.volatility_breakout),
      f"""WITH {bars_sql('1h')}, f AS (SELECT instrument, close_s, rn, {gated(f"(close - {M} + 2 * {SD}) / nullif(4 * {SD}, 0)", 20)} AS b, {gated(f"4 * {SD} / nullif({M}, 0)", 20)} AS bw, {RV} AS rv FROM bars),
 g AS (SELECT *, last_value(nullif(bw, 0) IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pbw FROM f),
 e AS (SELECT *, CASE WHEN bw > pbw AND rv >= 1.5 AND b > 1 THEN 'long' WHEN bw > pbw AND rv >= 1.5 AND b < 0 THEN 'short' END AS entry FROM g)
 SELECT instrument, close_s * 1000000 AS ts_us, entry, CASE WHEN entry IS NOT NULL THEN round(least(CASE WHEN b > 1 THEN b - 1 ELSE -b END / 0.5, 1), 6) END AS confidence,
 b IS NULL OR b BETWEEN 0 AND 1 AS exit_long FROM e""")


# --- user strategies ------------------------------------------------------------------------------
def volume_spike(candles: DataFrame, *, layout: str = "blocks") -> DataFrame:
    """A strategy written outside the catalogue: long on twice the usual volume, short on half of it."""
    def build(df: DataFrame, w) -> DataFrame:
        return df.withColumn("relative", X.relative_volume(F.col("volume"), w, 20))

    ready = X.indicator(candles, build, reach=20, layout=layout)
    x = F.col("relative")
    return ready.select(
        *X.KEYS, F.lit("volume_spike").alias("strategy_id"), F.col("close_time").alias("ts"), S.direction(x >= 2, x <= 0.5).alias("entry"), F.lit(1.0).alias("confidence"),
        F.lit(False).alias("manages_exit"), F.lit(False).alias("exit_long"), F.to_json(F.struct("relative")).alias("metadata"))


def plugged(spark: SparkSession, sf_dir: str) -> DataFrame:
    if "volume_spike" not in S.CATALOG:
        S.register(S.StrategyKind("volume_spike", "user", "candles", (S.LONG, S.SHORT), volume_spike))
    try:
        b = bars(spark, sf_dir, "1h")
        return signal_rows(S.candidates(b, b, ["volume_spike"], tape_layout(spark, sf_dir)))
    finally:
        S.CATALOG.pop("volume_spike", None)


R.add("udf_surface", plugged,
      f"WITH {bars_sql('1h')}, f AS (SELECT *, {RV} AS x FROM bars) SELECT instrument, close_s * 1000000 AS ts_us, CASE WHEN x >= 2 THEN 'long' ELSE 'short' END AS direction, 1.0::DOUBLE AS confidence FROM f WHERE x >= 2 OR x <= 0.5")
