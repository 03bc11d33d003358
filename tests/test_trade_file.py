"""The trade file: all its columns from trades, evaluations, switches and robots, and what is missing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickloom.operators import reports as Q
from tickloom.session import scratch_path
from tickloom.sources import lake as K

T0 = datetime(2024, 3, 1, 12)
TRADE = "position_id long, instrument string, strategy_id string, side string, opened_at timestamp, closed_at timestamp, quantity decimal(18,8), pnl_net decimal(18,8)"
EVALUATION = "instrument string, evaluated_at timestamp, selected string, regime string, evaluation_id long, regime_summary string"
SWITCH = "instrument string, switched_at timestamp, selected string, previous string, switch_id long, reason string"


def test_holding_times(spark):
    seconds = [0, 29, 30, 59 * 60 + 29, 59 * 60 + 30, 3600, 100 * 3600 + 61, -1]
    df = spark.createDataFrame([(i, T0, T0 + timedelta(seconds=s)) for i, s in enumerate(seconds)] + [(8, T0, None)], "i int, a timestamp, b timestamp")
    assert [r.h for r in df.select("i", Q.held(F.col("a"), F.col("b")).alias("h")).orderBy("i").collect()] == ["<1m", "<1m", "1m", "59m", "1h 0m", "1h 0m", "100h 1m", "—", "—"]


def test_all_columns_and_what_is_missing(spark):
    trades = spark.createDataFrame([(1, "A", "desk::momentum", "BUY", T0, T0 + timedelta(hours=2), 1, 2), (2, "A", "momentum@A", "sell", T0 - timedelta(days=9), T0 - timedelta(days=8), 1, 2),
                                    (3, "C", None, "buy", T0, None, None, None), (4, None, "x", "buy", T0, T0, 1, 1)],
                                   TRADE.replace("decimal(18,8)", "int")).withColumns({c: F.col(c).cast("decimal(18,8)") for c in ("quantity", "pnl_net")})
    evaluations = spark.createDataFrame([("A", T0 - timedelta(minutes=1), "desk::breakout", "trend", 1, 'said "up",\nthen down')], EVALUATION)
    switches = spark.createDataFrame([("A", T0 + timedelta(hours=2, seconds=1), "desk::breakout", None, 1, "better")], SWITCH)
    robots = spark.createDataFrame([("r1", "first, robot", "A", "1h")], "robot_id string, robot_name string, instrument string, timeframe string")
    out = Q.trade_file(Q.trade_export(trades, evaluations, switches, ["instrument"], layout="plain"), robots)
    path = scratch_path(spark, "trade-file")
    K.write_csv(out, path)
    back = spark.read.csv(path, header=True, schema=out.schema, quote='"', escape='"', multiLine=True)
    got = {r.trade_id: r for r in back.collect()}
    assert tuple(back.columns) == Q.TRADE_FILE and len(Q.TRADE_FILE) == 31 and sorted(got) == [1, 2, 3, 4]
    a, b, c, d = (got[i] for i in range(1, 5))
    assert (a.robot_id, a.robot_name, a.timeframe, a.strategy, a.direction, a.duration) == ("r1", "first, robot", "1h", "momentum", "long", "2h 0m")
    assert (a.judge_selected_strategy, a.judge_evaluated_at, a.regime_at_entry, a.regime_summary) == ("breakout", "2024-03-01T11:59:00.000000Z", "trend", 'said "up",\nthen down')
    assert (a.related_switch, a.related_switch_reason, a.related_switch_at) == ("none > breakout", "better", "2024-03-01T14:00:01.000000Z")
    # Before any evaluation, and without a switch; what trades lack is null.
    assert (b.strategy, b.direction, b.judge_evaluated_at, b.related_switch, b.entry_price, b.exit_trigger, b.regime_strength) == ("momentum", "sell", None, None, None, None, None)
    assert (c.robot_id, c.strategy, c.closed_at, c.duration, c.pnl_net) == (None, None, None, "—", None)
    assert (d.symbol, d.robot_id, d.duration) == (None, None, "<1m")


def test_a_csv_file_is_bounded(spark, tmp_path, monkeypatch):
    """A file with line breaks is read by one task, so no task may write all of a table into one."""
    monkeypatch.setattr(K, "CSV_ROWS", 10)
    K.write_csv(spark.range(35).selectExpr("id", "concat(id, ' of\\nS') AS text").coalesce(1), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("part-*.csv"))) == 4
    back = spark.read.csv(str(tmp_path / "t"), header=True, schema="id long, text string", quote='"', escape='"', multiLine=True)
    assert back.count() == 35 and back.filter("text LIKE '% of\\nS'").count() == 35
