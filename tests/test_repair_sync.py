"""Published bars that late trades repair, and robots that start and stop while a stream runs."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickloom.operators import candles as C
from tickloom.session import scratch_path
from tickloom.sources import commits, published
from tickloom.streaming import jobs as J

TRADE = "instrument string, ts timestamp, trade_id long, price decimal(18,8), quantity decimal(18,8)"
START = datetime(2024, 1, 1, 22)


def random_trades(n=120):
    """Two days of trades, a null instrument among them, many at the same time, one at the same time and number."""
    rng = random.Random(5)
    out = [(rng.choice(["A", "A", "A", "B", None]), START + timedelta(minutes=rng.randint(0, 300)), i, Decimal(rng.randint(1, 40)), Decimal(rng.randint(0, 5))) for i in range(n)]
    return out + [("A", START, 500, Decimal(3), Decimal(1))]


def bars_of(df):
    return rows(df.select("instrument", "open_time", "close_time", "timeframe", "open", "high", "low", "close", "volume"))


def test_bars_equal_those_of_all_trades_in_whatever_order_they_come(spark):
    trades = random_trades()
    shuffled = random.Random(1).sample(trades, len(trades))
    path = scratch_path(spark, "bars")
    sink = J.bars_sink(path, "m5")
    for n in range(4):
        sink(spark.createDataFrame(shuffled[n::4], TRADE), n)
    got = published.read_bars(spark, path)
    assert bars_of(got) == bars_of(C.candles_from_trades(spark.createDataFrame(trades, TRADE), "5m"))
    assert got.agg(F.sum("trades")).first()[0] == len(trades)
    # A bar is repaired if trades of several batches are in it.
    batches = {}
    for n in range(4):
        for t in shuffled[n::4]:
            batches.setdefault((t[0], t[1].replace(minute=t[1].minute // 5 * 5)), set()).add(n)
    assert {(r.instrument, r.open_time): (r.repaired, r.revision) for r in got.collect()} == {k: (len(v) > 1, max(v)) for k, v in batches.items()}


def test_a_replay_adds_nothing_and_a_lost_batch_leaves_the_bars(spark, monkeypatch):
    path = scratch_path(spark, "bars")
    sink = J.bars_sink(path, "1h")
    first, late = (spark.createDataFrame([("A", START + timedelta(hours=h), i, Decimal(p), Decimal(1))], TRADE) for i, (h, p) in enumerate([(5, 7), (0, 9)]))
    sink(first, 0)
    sink(first, 0)
    assert [r.trades for r in published.read_bars(spark, path).collect()] == [1]
    before = bars_of(published.read_bars(spark, path))
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sink(late.unionByName(first), 1)
    assert bars_of(published.read_bars(spark, path)) == before
    kept = {r.folder for r in commits.folders(spark, path).collect()}
    sink(late, 1)
    # The day of the late trade is new, the other one was not written again.
    assert kept < {r.folder for r in commits.folders(spark, path).collect()}
    sink(late.limit(0), 2)
    sink(spark.createDataFrame([("A", None, 9, Decimal(1), Decimal(1))], TRADE), 3)
    got = published.read_bars(spark, path)
    assert [(r.open_time.hour, r.trades, r.repaired) for r in got.orderBy("open_time").collect()] == [(22, 1, False), (3, 1, False)]
    assert published.read_bars(spark, path, "A", "2024-01-02").count() == 1 and published.read_bars(spark, path, version=1).count() == 1


CANDLE = "instrument string, timeframe string, open_time timestamp, close_time timestamp, close double, is_closed boolean"
LOG = "robot_id string, instrument string, timeframe string, candidate_kinds array<string>, status string, changed_at timestamp"


def candles(spark, symbol, first, last, closed=True):
    at = [START + timedelta(hours=h) for h in range(first, last)]
    return spark.createDataFrame([(symbol, "1h", t, t + timedelta(hours=1), float(i), closed) for i, t in enumerate(at)], CANDLE)


def given(spark, path, batch):
    out = {}
    for r in spark.read.parquet(f"{path}/rows/batch={batch}").collect():
        warm, live = out.setdefault(r.robot_id, ([], []))
        (warm if r.warmup else live).append(int((r.open_time - START).total_seconds() // 3600))
    return {k: (sorted(w), sorted(v)) for k, (w, v) in out.items()}


def test_robots_start_warm_stop_and_come_back(spark):
    hour = lambda h: START + timedelta(hours=h)
    entry = lambda robot, symbol, status, h: (robot, symbol, "1h", ["momentum"], status, hour(h))
    log = [entry("old", "A", "running", -9), entry("gone", "A", "running", -9), entry("off", "A", "stopped", -9), entry("new", "A", "running", 12), entry("gone", "A", "stopped", 12),
           entry("old", "B", "running", 22), entry("gone", "A", "running", 32)]
    log += [entry(r, "A", "stopped", 42) for r in ("old", "gone", "new")]
    read = lambda: spark.createDataFrame(log, LOG)
    path = scratch_path(spark, "sync")
    sink = J.robot_sync_sink(path, read, history=candles(spark, "A", -5, 0), bars=3)
    both = lambda first, last: candles(spark, "A", first, last).unionByName(candles(spark, "B", first, last)).unionByName(candles(spark, "A", last, last + 1, closed=False))
    for n in range(5):
        sink(both(10 * n, 10 * n + 10), n)
    live = [list(range(10 * n, 10 * n + 10)) for n in range(5)]
    assert given(spark, path, 0) == {"old": ([-3, -2, -1], live[0]), "gone": ([-3, -2, -1], live[0])}
    assert given(spark, path, 1) == {"old": ([], live[1]), "new": ([7, 8, 9], live[1])}
    # Another series is a new start; so is a robot that comes back.
    assert given(spark, path, 2) == {"old": ([17, 18, 19], live[2]), "new": ([], live[2])}
    assert given(spark, path, 3) == {"old": ([], live[3]), "new": ([], live[3]), "gone": ([27, 28, 29], live[3])}
    # None runs any more: those there are stay.
    assert {k: v[1] for k, v in given(spark, path, 4).items()} == {"old": live[4], "new": live[4], "gone": live[4]}
    last = given(spark, path, 4)
    sink(both(40, 50), 4)
    assert given(spark, path, 4) == last
    # Kept are the candles a robot would be warmed up with, of the last two batches' states.
    assert spark.read.parquet(f"{path}/newest/v=4").count() == 6 and J._versions(spark, f"{path}/newest") == J._versions(spark, f"{path}/active") == [3, 4]
    sink(both(50, 50).limit(0), 5)
    assert given(spark, path, 5) == {} and spark.read.parquet(f"{path}/active/v=5").count() == 3
