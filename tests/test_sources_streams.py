"""Lake round trips, message parsing, and streams fed in several batches."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import features as X
from tickloom.operators import joins as N
from tickloom.operators import performance as P
from tickloom.sources import lake as K
from tickloom.sources import messages as M
from tickloom.session import scratch_path
from tickloom.streaming import jobs as J
from test_candles_features import DDL, minute


def test_missing_lake_reads_as_no_rows(spark):
    assert K.read_candles(spark, scratch_path(spark, "absent")).count() == 0


def test_candles_survive_exactly(spark):
    df = spark.createDataFrame([minute(i, 0.12345678 + i) for i in range(4)], DDL)
    path = scratch_path(spark, "candles")
    K.write_candles(df, path)
    assert rows(K.read_candles(spark, path).select(*df.columns)) == rows(df)


def test_scale_guard_rejects_nine_decimals(spark):
    df = spark.createDataFrame([(1, "0.12345678"), (2, "0.123456789")], "id int, text string").select("id", F.col("text").cast("decimal(38,18)").alias("price"))
    good, bad = M.scale_guard(df, ["price"])
    assert [r["id"] for r in good.collect()] == [1] and [(r["id"], r["offending_column"]) for r in bad.collect()] == [(2, "price")]


def test_names_that_differ_only_in_case(spark):
    raw = spark.createDataFrame([("x@trade", '{"s":"AB","t":7,"T":9000,"p":"1.5","q":"2","m":true}', datetime(2024, 1, 1)), ("x@trade", "{broken", datetime(2024, 1, 1)), ("x@other", "{}", datetime(2024, 1, 1))],
                                schemas.RAW_MESSAGES)
    t = M.route(raw)["trades"].collect()
    assert len(t) == 1 and (t[0]["exchange_trade_id"], t[0]["timestamp_ms"], t[0]["is_buy"]) == ("7", 9000, False)


def test_uuid_is_the_standard_name_uuid(spark):
    import uuid

    from tickloom.functions.text import ID_NAMESPACE, name_uuid

    df = spark.createDataFrame([("BTCUSDT",), ("ÉTH",)], "s string")
    assert {r["s"]: r["u"] for r in df.select("s", name_uuid(F.col("s")).alias("u")).collect()} == {s: str(uuid.uuid5(uuid.UUID(ID_NAMESPACE), s)) for s in ("BTCUSDT", "ÉTH")}


def test_tick_rounding_is_half_even(spark):
    from tickloom.functions.money import floor_to_lot, round_to_tick

    df = spark.createDataFrame([(Decimal("2.5"), Decimal(1)), (Decimal("3.5"), Decimal(1)), (Decimal("2.55"), Decimal("0.1")), (Decimal("7"), Decimal(0))], "p decimal(18,8), t decimal(18,8)")
    assert [float(r[0]) for r in df.select(round_to_tick(F.col("p"), F.col("t"))).collect()] == [2.0, 4.0, 2.6, 7.0]
    assert [float(r[0]) for r in df.select(floor_to_lot(F.col("p"), F.col("t"))).collect()] == [2.0, 3.0, 2.5, 7.0]


def test_existing_id_survives_an_upsert(spark):
    old = spark.createDataFrame([("BTC", "id1", 1.0), ("ETH", "id2", 2.0)], "symbol string, id string, tick double")
    new = spark.createDataFrame([("BTC", "other", 9.0), ("SOL", "id3", 3.0)], "symbol string, id string, tick double")
    assert rows(N.stable_upsert(old, new, ["symbol"], "id")) == [("BTC", "id1", 9.0), ("ETH", "id2", 2.0), ("SOL", "id3", 3.0)]


TRADE = "position_id long, strategy_id string, status string, opened_at timestamp, closed_at timestamp, pnl_gross decimal(18,5), pnl_net decimal(18,5), fees_paid decimal(18,5), spread_paid decimal(18,5), slippage_paid decimal(18,5)"


def test_trade_statistics_by_hand(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    nets = [100, -40, 0, 60, -100]
    data = [(i, "s", "closed", t0, t0 + timedelta(seconds=10 * (i + 1)), Decimal(n + 1), Decimal(n), Decimal(1), Decimal(0), Decimal(0)) for i, n in enumerate(nets)]
    data.append((9, "s", "open", t0, None, None, None, Decimal(1), Decimal(0), Decimal(0)))
    df = spark.createDataFrame(data, TRADE)
    for layout in ("plain", "blocks"):
        r = P.with_drawdown(df, layout=layout).first()
        assert (r["total_trades"], r["winners"], r["losers"], r["win_rate"], r["net_pnl"]) == (5, 2, 2, 0.4, 20.0)
        assert (r["average_win"], r["average_loss"], r["profit_factor"]) == (80.0, 70.0, pytest.approx(160 / 140))
        assert r["expectancy"] == pytest.approx(0.4 * 80 - 0.6 * 70) and r["max_drawdown"] == 100.0 and r["average_duration_s"] == 30
    only_wins = P.performance(df.filter("pnl_net > 0")).first()
    assert only_wins["profit_factor"] is None and only_wins["average_loss"] == 0.0
    wanted = spark.createDataFrame([("s",), ("idle",)], "strategy_id string")
    assert P.complete(P.performance(df), wanted, ["strategy_id"]).filter("strategy_id = 'idle'").first()["total_trades"] == 0


def test_equity_report_chains_periods(spark):
    points = [("2024-01-30 10:00", 110.0), ("2024-01-30 12:00", 100.0), ("2024-01-31 09:00", 120.0), ("2024-02-01 09:00", 90.0)]
    df = spark.createDataFrame([("p", n, t, e, e / 100 - 1) for n, (t, e) in enumerate(points)], "k string, seq long, t string, equity double, return_pct double").withColumn("ts", F.col("t").cast("timestamp"))
    r = P.equity_report(df, ["k"], 100.0).first()
    assert (r["positive_days"], r["negative_days"], r["flat_days"]) == (1, 1, 1)
    assert r["max_drawdown_pct"] == pytest.approx(0.25) and r["net_return_pct"] == pytest.approx(-0.1)
    assert [x["return_pct"] for x in r["monthly_returns"]] == [pytest.approx(0.2), pytest.approx(-0.25)]


def test_streamed_features_continue_across_batches(spark):
    """Three files, one per batch: state carries over and a repeated bar changes nothing."""
    rng = random.Random(8)
    bars, price = [], 100.0
    for i in range(90):
        price *= 1 + rng.gauss(0, 0.01)
        bars.append(minute(i, round(price, 4), 50 + rng.randint(0, 100)))
    source = scratch_path(spark, "source")
    sink, progress = scratch_path(spark, "sink"), scratch_path(spark, "progress")
    schema = spark.createDataFrame(bars, DDL).schema
    for part in (bars[:30], [*bars[30:60], bars[59]], [bars[59], *bars[60:]]):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
        J.start(J.closed_once(spark.readStream.schema(schema).parquet(source)), J.feature_sink(sink), progress).awaitTermination()
    sink = f"{sink}/rows"
    columns = ["ret_60", "sma", "zscore", "percent_b", "reg_r2", "autocorrelation", "ema", "atr", "rsi", "ewma_volatility"]
    pick = lambda df: rows(df.select("close_time", *[F.round(c, 8).alias(c) for c in columns]))
    assert pick(spark.read.parquet(sink)) == pick(X.feature_series(spark.createDataFrame(bars, DDL)))


def test_streamed_candidates_equal_the_batch_ones(spark):
    from tickloom.operators import signals as G

    rng = random.Random(12)
    bars, price = [], 100.0
    for i in range(120):
        price *= 1 + rng.gauss(0, 0.015)
        bars.append(minute(i, round(price, 4), 50 + rng.randint(0, 300)))
    df = spark.createDataFrame(bars, DDL)
    source, sink = scratch_path(spark, "source"), scratch_path(spark, "sink")
    df.write.parquet(source)
    J.start(spark.readStream.schema(df.schema).parquet(source), J.candidate_sink(sink), scratch_path(spark, "progress")).awaitTermination()
    sink = f"{sink}/rows"
    pick = lambda d: rows(d.filter("entry IS NOT NULL OR exit_long").select("strategy_id", "ts", "entry", "exit_long", "manages_exit", F.round("confidence", 8)))
    expect = pick(G.candidates(df, X.feature_series(df)))
    assert pick(spark.read.parquet(sink)) == expect and len({r[0] for r in expect}) == 6


def test_late_rows_are_kept_and_counted(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    source, sink, progress = (scratch_path(spark, n) for n in ("source", "sink", "progress"))
    ddl = "id long, ts timestamp"
    for part in ([(1, 0), (2, 100)], [(3, 95), (4, 200), (5, 10)], [(6, 140), (7, 139), (8, None)]):
        spark.createDataFrame([(i, None if s is None else t0 + timedelta(seconds=s)) for i, s in part], ddl).coalesce(1).write.mode("append").parquet(source)
        J.start(spark.readStream.schema(ddl).parquet(source), J.late_sink(sink, "ts", 60), progress).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{sink}/late").collect()) == [5, 7]
    assert sorted(r.id for r in spark.read.parquet(f"{sink}/rows").collect()) == [1, 2, 3, 4, 6, 8]


def test_closed_bars_are_never_too_late(spark):
    bars = [minute(i, 100.0 + i) for i in range(60)]
    source, sink, progress = (scratch_path(spark, n) for n in ("source", "sink", "progress"))
    schema = spark.createDataFrame(bars, DDL).schema
    for part in (bars[30:], bars[:31], bars[:5]):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
        J.start(J.closed_once(spark.readStream.schema(schema).parquet(source)), J.table_sink(sink), progress).awaitTermination()
    assert rows(spark.read.parquet(sink).select("open_time")) == rows(spark.createDataFrame(bars, DDL).select("open_time"))


def test_late_bars_come_out_marked(spark):
    bars = [minute(i, 100.0 + i) for i in range(40)]
    source, sink, progress = (scratch_path(spark, n) for n in ("source", "sink", "progress"))
    schema = spark.createDataFrame(bars, DDL).schema
    for part in (bars[10:], [bars[3], bars[39]]):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
        J.start(spark.readStream.schema(schema).parquet(source), J.feature_sink(sink, layout="plain"), progress).awaitTermination()
    out = spark.read.parquet(f"{sink}/rows")
    assert out.filter("NOT late").count() == 30 and [r.close for r in out.filter("late").collect()] == [103.0]


def test_streamed_features_skip_prices_without_logarithm(spark):
    prices = [100.0 + i for i in range(30)] + [0.0] + [110.0 + i for i in range(40)]
    source, sink = scratch_path(spark, "source"), scratch_path(spark, "sink")
    df = spark.createDataFrame([minute(i, p) for i, p in enumerate(prices)], DDL)
    df.write.parquet(source)
    J.start(spark.readStream.schema(df.schema).parquet(source), J.feature_sink(sink, layout="plain"), scratch_path(spark, "progress")).awaitTermination()
    assert spark.read.parquet(f"{sink}/rows").count() == len(prices)


def test_poison_messages_are_quarantined(spark):
    good, at = '{"s":"A","t":1,"T":9000,"p":"1.5","q":"%s","m":true}', datetime(2024, 1, 1)
    deep = '{"s":"A","U":1,"u":2,"b":[["1","2"],["%s","1"]],"a":[]}'
    raw = spark.createDataFrame(
        [("x@trade", good % q, at) for q in ("1.12345678", "1.123456789", "1.1234567800", "20000000000", "1e-9", "1e2", "1" + "0" * 40)]
        + [("x@depth", deep % p, at) for p in ("3", "20000000000.5", "1.123456789", "x")], schemas.RAW_MESSAGES)
    tables = M.route(raw)
    assert sorted(r.quantity for r in tables["trades"].collect()) == [Decimal("1.12345678"), Decimal("1.12345678"), Decimal(100), Decimal(20000000000)]
    assert sorted(r.bids[1].price for r in tables["book_deltas"].collect()) == [Decimal(3), Decimal("20000000000.5")]
    assert {r.route: (r.messages, r.malformed) for r in M.quarantine(raw).collect()} == {"trades": (7, 3), "book_deltas": (4, 2), "klines": (0, 0), "book_ticker": (0, 0), "book_snapshots": (0, 0), "unknown": (0, 0)}


def test_a_field_of_a_message_is_parsed_once(spark, capsys):
    tables = M.route(spark.createDataFrame([("x@trade", "{}", datetime(2024, 1, 1))], schemas.RAW_MESSAGES))
    parses = {}
    for kind, table in tables.items():
        table.explain()
        parses[kind] = capsys.readouterr().out.count("get_json_object(payload")
    assert parses == {"trades": 6, "book_ticker": 6, "book_deltas": 5, "book_snapshots": 3, "klines": 10}


def test_sinks_refuse_nine_decimals(spark):
    rows_ = spark.createDataFrame([("A", 1, Decimal("1.123456789"))], "symbol string, ms long, price decimal(38,18)")
    ticks = rows_.select("symbol", F.lit("1").alias("exchange_trade_id"), "price", F.lit(1).cast("decimal(38,8)").alias("quantity"), F.lit(True).alias("is_buy"), F.col("ms").alias("timestamp_ms"))
    with pytest.raises(Exception, match="more than eight decimals in price"):
        K.append_ticks("trades", ticks, scratch_path(spark, "ticks"))
    kept = scratch_path(spark, "ticks")
    K.append_ticks("trades", ticks.withColumn("price", F.lit("1.12345678").cast("decimal(38,18)")), kept)
    assert K.read_ticks(spark, kept, "trades").first().price == Decimal("1.12345678")


def test_large_volumes_resample(spark):
    from tickloom.operators import candles as C

    big = [(*minute(i, 1.0)[:-2], Decimal(9_000_000_000), True) for i in range(5)]
    assert C.resample(spark.createDataFrame(big, DDL), "1m", "5m").first().volume == 45_000_000_000


def test_seen_bars_are_runs_and_none_is_lost(spark):
    """Bars in any order, with copies, gaps that fill up late and one beside the grid: each comes once, and the runs stay few."""
    from tickloom.operators import candles as C

    rng = random.Random(3)
    order = list(range(60))
    rng.shuffle(order)
    at = {b[2]: b for b in (minute(i, 100.0 + i) for i in range(60))}
    beside = list(minute(7, 5.0))
    beside[2], beside[3] = beside[2] + timedelta(seconds=30), beside[3] + timedelta(seconds=30)
    bars = [minute(i, 100.0 + i) for i in order]
    sink, got = scratch_path(spark, "sink"), []
    batches = [bars[:40], bars[30:50] + bars[:3], [tuple(beside)], bars[10:], bars]
    for n, part in enumerate(batches):
        J.closed_once_sink(sink, layout="blocks" if n == 1 else "plain")(spark.createDataFrame(part + part[:2], DDL), n)
        J.closed_once_sink(sink, layout="plain")(spark.createDataFrame(part, DDL), n)
    got = spark.read.parquet(f"{sink}/rows").collect()
    assert len(got) == 61 and len({r.open_time for r in got}) == 61 and len(at) == 60
    runs = spark.read.schema(C.SEEN_DDL).parquet(f"{sink}/seen/v=4").collect()
    assert len(runs) == 2 and sorted((r.end - r.start).total_seconds() for r in runs) == [0, 59 * 60]


def test_a_crowded_series_is_routed_by_many_tasks(spark):
    """Thousands of robots, or instances, on one series: their pairs are made by several tasks, and all are there."""
    from tickloom.operators import signals as G

    candles = spark.range(20).coalesce(1).selectExpr("if(id < 19, 'A', 'B') AS instrument", "'1h' AS timeframe", "id AS n")
    robots = spark.range(5001).selectExpr("concat('r', id) AS robot_id", "if(id < 5000, 'A', 'B') AS instrument", "'1h' AS timeframe", "array('momentum') AS candidate_kinds", "'running' AS status")
    routed = J.route_to_robots(candles, robots)
    assert routed.select("n", "robot_id").distinct().count() == routed.count() == 19 * 5000 + 1
    assert routed.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    assert routed.columns == ["instrument", "timeframe", "n", "robot_id", "candidate_kinds"]
    sent = G.dispatch(candles.selectExpr("n", "'momentum' AS strategy_id", "instrument"), robots.selectExpr("robot_id AS id", "'momentum' AS kind", "instrument AS symbol"))
    assert sent.select("n", "strategy_id").distinct().count() == sent.count() == 19 * 5000 + 1
    assert sent.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_rows_that_crowd_on_a_key_are_paired_by_many_tasks(spark):
    """Thousands of rows on one key of some instances: no task makes most pairs; equal rows and rows without a key are as in a plain join."""
    from tickloom.operators import joins
    from tickloom.operators import signals as G

    trades = spark.range(3000).coalesce(1).selectExpr("id div 2 AS n", "if(id < 2900, 'momentum', if(id < 2950, 'other', null)) AS strategy_id", "if(id < 2800, 'A', 'B') AS instrument")
    robots = spark.range(300).selectExpr("concat('r', id div 3) AS id", "if(id < 290, 'momentum', null) AS kind", "if(id < 240, 'A', if(id < 280, 'B', null)) AS symbol")
    sent = G.dispatch(trades, robots)
    by_kind = trades.withColumnRenamed("strategy_id", "kind")
    wanted = by_kind.join(robots.withColumnRenamed("symbol", "instrument"), ["kind", "instrument"]).withColumnRenamed("id", "strategy_id")
    assert sent.columns == wanted.columns == ["kind", "instrument", "n", "strategy_id"]
    assert sent.exceptAll(wanted).count() == wanted.exceptAll(sent).count() == 0
    by_task = [r["count"] for r in sent.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(by_task) == 2800 * 240 + 100 * 40 and max(by_task) < sum(by_task) / 3
    in_parts = joins.crowded_pairs(by_kind, robots.withColumnRenamed("symbol", "instrument"), ["kind", "instrument"], rows=7, most=1000)
    assert in_parts.withColumnRenamed("id", "strategy_id").exceptAll(wanted).count() == 0 and in_parts.count() == sum(by_task)
    assert G.dispatch(trades.limit(0), robots).count() == G.dispatch(trades, robots.limit(0)).count() == 0
    assert G.dispatch(trades.filter("strategy_id = 'other'"), robots).count() == 0
