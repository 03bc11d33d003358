"""Registered queries of signal research over a 15-minute feature grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import research as S
from tickloom.plans.adapters import TAPE_SQL, bars, bars_sql, r6, tape, tape_layout
from tickloom.plans.registry import Registry

R = Registry()
STEP = 900
HORIZONS = (900, 3600, 14400)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute bars of each event type read as grid rows; thin bars have no tape features."""
    b = bars(spark, sf_dir, "15m")
    o, h, l, c, v = (F.col(x).cast("double") for x in ("open", "high", "low", "close", "volume"))
    busy = v > 60
    return b.select(
        F.col("instrument").alias("symbol"), (F.unix_seconds("open_time") * 1000).alias("timestamp_ms"),
        (h - l).alias("spread_abs"), ((h - l) / c / 1000).alias("spread_pct"), c.alias("mid_price"), ((o + c) / 2).alias("microprice"),
        ((c - o) / (h + l)).alias("bid_ask_imbalance"), (c / h - 0.5).alias("book_imbalance"),
        F.when(busy, (v - 100) / v).alias("trade_imbalance"), F.when(busy, v - 100).alias("volume_delta"), F.when(busy, v / 900).alias("trade_intensity"),
        F.when(h > l, o - c).alias("order_flow_imbalance"))


GRID_SQL = f"""{bars_sql('15m')},
 grid AS (
  SELECT instrument AS symbol, open_s * 1000 AS timestamp_ms, high - low AS spread_abs, (high - low) / close / 1000 AS spread_pct, close AS mid_price, (open + close) / 2 AS microprice,
   (close - open) / (high + low) AS bid_ask_imbalance, close / high - 0.5::DOUBLE AS book_imbalance, CASE WHEN volume > 60 THEN (volume - 100) / volume END AS trade_imbalance,
   CASE WHEN volume > 60 THEN volume - 100 END AS volume_delta, CASE WHEN volume > 60 THEN volume / 900 END AS trade_intensity, CASE WHEN high > low THEN open - close END AS order_flow_imbalance FROM bars),
 fwd AS (
  SELECT a.*, h.horizon, (b.mid_price - a.mid_price) / a.mid_price AS y FROM grid a CROSS JOIN (VALUES (900::BIGINT), (3600::BIGINT), (14400::BIGINT)) h(horizon)
  JOIN grid b ON b.symbol = a.symbol AND b.timestamp_ms = a.timestamp_ms + h.horizon * 1000),
 long AS ({' UNION ALL '.join(f"SELECT symbol, timestamp_ms, horizon, y, '{n}' AS feature, {str(d).lower()} AS is_directional, {'microprice - mid_price' if n == 'microprice_deviation' else n} AS x FROM fwd" for n, d in S.FEATURES)}),
 samples AS (SELECT * FROM long WHERE x IS NOT NULL)"""
G = ["symbol", "feature", "horizon"]
GS = "symbol, feature, horizon"
PEARSON = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.samples(grid(spark, sf_dir), HORIZONS)


def summed(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "feature").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x"), "mean_x"))


R.add("sig_feature_unpivot", lambda s, d: summed(S.unpivot_features(grid(s, d), ["symbol"])),
      f"""WITH {GRID_SQL}, u AS ({' UNION ALL '.join(f"SELECT symbol, '{n}' AS feature, {'microprice - mid_price' if n == 'microprice_deviation' else n} AS x FROM grid" for n, _ in S.FEATURES)})
 SELECT symbol, feature, count(x) AS n, round(avg(x), 6) AS mean_x FROM u GROUP BY ALL""")
R.add("sig_forward_return", lambda s, d: S.forward_returns(grid(s, d), HORIZONS).select("symbol", "timestamp_ms", "horizon", r6("y")),
      f"WITH {GRID_SQL} SELECT symbol, timestamp_ms, horizon, round(y, 6) AS y FROM fwd")
R.add("sig_pearson", lambda s, d: S.basic_statistics(long(s, d), step_seconds=STEP).select(*G, "n", r6("pearson")),
      f"WITH {GRID_SQL} SELECT {GS}, count(*) AS n, round({PEARSON}, 6) AS pearson FROM samples GROUP BY ALL")
R.add("sig_n_effective", lambda s, d: S.basic_statistics(long(s, d), step_seconds=STEP).select(*G, "n_effective"),
      f"WITH {GRID_SQL} SELECT {GS}, greatest(count(*) // (any_value(horizon) // {STEP}), 1) AS n_effective FROM samples GROUP BY symbol, feature, horizon")
R.add("sig_hit_rate", lambda s, d: S.basic_statistics(long(s, d), step_seconds=STEP).select(*G, r6("hit_rate")),
      f"WITH {GRID_SQL} SELECT {GS}, round(CASE WHEN any_value(is_directional) THEN avg(CASE WHEN x <> 0 AND y <> 0 THEN CASE WHEN sign(x) = sign(y) THEN 1 ELSE 0 END END) END, 6) AS hit_rate FROM samples GROUP BY ALL")
R.add("sig_rank_avg", lambda s, d: S.average_ranks(long(s, d), G, "x", "rank", tape_layout(s, d)).select(*G, "timestamp_ms", r6("rank")),
      f"""WITH {GRID_SQL} SELECT {GS}, timestamp_ms, round(rank() OVER (PARTITION BY {GS} ORDER BY x) + (count(*) OVER (PARTITION BY {GS}, x) - 1) / 2.0::DOUBLE, 6) AS rank
 FROM samples""")
R.add("sig_spearman", lambda s, d: S.spearman(long(s, d), layout=tape_layout(s, d)).select(*G, r6("spearman")),
      f"""WITH {GRID_SQL}, ranked AS (SELECT {GS}, rank() OVER (PARTITION BY {GS} ORDER BY x) + (count(*) OVER (PARTITION BY {GS}, x) - 1) / 2.0::DOUBLE AS x,
  rank() OVER (PARTITION BY {GS} ORDER BY y) + (count(*) OVER (PARTITION BY {GS}, y) - 1) / 2.0::DOUBLE AS y FROM samples)
 SELECT {GS}, round({PEARSON}, 6) AS spearman FROM ranked GROUP BY ALL""")
DECILES = [f"decile_{k}" for k in range(1, 11)]
R.add("sig_deciles", lambda s, d: S.deciles(long(s, d), layout=tape_layout(s, d)).select(*G, *[r6(c) for c in (*DECILES, "decile_spread")]),
      f"""WITH {GRID_SQL}, o AS (SELECT {GS}, y, row_number() OVER (PARTITION BY {GS} ORDER BY x, timestamp_ms) - 1 AS i, count(*) OVER (PARTITION BY {GS}) AS n FROM samples),
 m AS (SELECT {GS}, {', '.join(f'avg(y) FILTER (i >= {k - 1} * n // 10 AND i < {k} * n // 10) AS decile_{k}' for k in range(1, 11))} FROM o WHERE n >= 10 GROUP BY ALL)
 SELECT {GS}, {', '.join(f'round({c}, 6) AS {c}' for c in DECILES)}, round(decile_10 - decile_1, 6) AS decile_spread FROM m""")
R.add("sig_split_half", lambda s, d: S.split_half(long(s, d), layout=tape_layout(s, d)).select(*G, r6("first_half"), r6("second_half"), "stable_sign"),
      f"""WITH {GRID_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY {GS} ORDER BY timestamp_ms) AS i, count(*) OVER (PARTITION BY {GS}) AS n FROM samples),
 a AS (SELECT {GS}, {PEARSON} AS fh FROM o WHERE i <= n // 2 GROUP BY ALL), b AS (SELECT {GS}, {PEARSON} AS sh FROM o WHERE i > n // 2 GROUP BY ALL)
 SELECT {GS}, round(fh, 6) AS first_half, round(sh, 6) AS second_half, CASE WHEN fh <> 0 AND sh <> 0 THEN sign(fh) = sign(sh) END AS stable_sign FROM a JOIN b USING ({GS})""")
R.add("sig_round_trip_cost", lambda s, d: S.round_trip_cost(grid(s, d)).select("symbol", r6("round_trip_cost"), "grid_points"),
      f"WITH {GRID_SQL} SELECT symbol, round(avg(spread_pct) + 0.0026::DOUBLE, 6) AS round_trip_cost, count(*) AS grid_points FROM grid GROUP BY ALL")
R.add("sig_block_bootstrap_ci", lambda s, d: S.block_bootstrap(long(s, d), step_seconds=STEP).select(*G, r6("ci95_low"), r6("ci95_high")))
R.add("sig_edge_vs_cost", lambda s, d: S.deciles(long(s, d), layout=tape_layout(s, d)).join(S.round_trip_cost(grid(s, d)), "symbol").select(*G, (F.abs("decile_spread") > F.col("round_trip_cost")).alias("edge_exceeds_cost")),
      f"""WITH {GRID_SQL}, o AS (SELECT {GS}, y, row_number() OVER (PARTITION BY {GS} ORDER BY x, timestamp_ms) - 1 AS i, count(*) OVER (PARTITION BY {GS}) AS n FROM samples),
 m AS (SELECT {GS}, avg(y) FILTER (i >= 9 * n // 10) - avg(y) FILTER (i < n // 10) AS spread FROM o GROUP BY ALL), c AS (SELECT symbol, avg(spread_pct) + 0.0026::DOUBLE AS cost FROM grid GROUP BY ALL)
 SELECT {GS}, abs(spread) > cost AS edge_exceeds_cost FROM m JOIN c USING (symbol)""")
R.add("sig_analyze", lambda s, d: S.analyze(grid(s, d), HORIZONS, step_seconds=STEP, layout=tape_layout(s, d)).select(
      *G, "is_directional", "n", "n_effective", *[r6(c) for c in ("pearson", "spearman", "hit_rate", "decile_spread", "first_half", "second_half", "ci95_low", "ci95_high", "round_trip_cost")], "stable_sign", "edge_exceeds_cost"))
# The report holds one row per symbol with as many statistics rows as the analysis has.
R.add("sig_report_job", lambda s, d: S.round_trip_cost(grid(s, d)).join(S.basic_statistics(long(s, d), step_seconds=STEP).groupBy("symbol").agg(F.count(F.lit(1)).alias("stats")), "symbol").select("symbol", "grid_points", "stats", r6("round_trip_cost")),
      f"""WITH {GRID_SQL}, k AS (SELECT DISTINCT {GS} FROM samples) SELECT symbol, any_value(n) AS grid_points, count(*) AS stats, round(any_value(c), 6) AS round_trip_cost
 FROM k JOIN (SELECT symbol, count(*) AS n, avg(spread_pct) + 0.0026::DOUBLE AS c FROM grid GROUP BY ALL) USING (symbol) GROUP BY symbol""")
R.add("percentile_linear", lambda s, d: S.exact_percentiles(tape(s, d).withColumn("price", F.col("price").cast("double")), ["instrument"], "price", {"p25": 0.025, "p500": 0.5, "p975": 0.975}, tape_layout(s, d)).select("instrument", r6("p25"), r6("p500"), r6("p975")),
      f"WITH {TAPE_SQL} SELECT instrument, round(quantile_cont(CAST(price AS DOUBLE), 0.025), 6) AS p25, round(quantile_cont(CAST(price AS DOUBLE), 0.5), 6) AS p500, round(quantile_cont(CAST(price AS DOUBLE), 0.975), 6) AS p975 FROM tape GROUP BY instrument")
