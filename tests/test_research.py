"""Signal statistics against direct computation."""

import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickloom.functions import draws as D
from tickloom.operators import research as S

GRID = "symbol string, timestamp_ms long, " + ", ".join(f"{n} double" for n in (
    "spread_abs", "spread_pct", "mid_price", "microprice", "bid_ask_imbalance", "book_imbalance", "trade_imbalance", "volume_delta", "trade_intensity", "order_flow_imbalance"))


def plain_draws(count, seed=1337):
    x, out = seed, []
    for _ in range(count):
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        out.append(x)
    return out


def test_jumped_draws_equal_the_sequence():
    expect = plain_draws(60)
    for each, first, count in ((3, 0, 20), (7, 2, 5), (1, 10, 50)):
        states = D.replicate_states(each, first, count)
        got = []
        for _ in range(each):
            states = D.step(states)
            got.append(states.copy())
        flat = np.array(got).T.ravel().tolist()
        assert flat == expect[each * first:each * (first + count)]


def brute_interval(x, y, block):
    n, stats, x, y = len(x), [], np.array(x), np.array(y)
    block = min(max(block, 1), n)
    count = -(-n // block)
    units = iter(np.array(plain_draws(count * 1000)) / float(2**32 - 1))
    for _ in range(1000):
        index = []
        while len(index) < n:
            start = min(int(next(units) * (n - block + 1.0)), n - block)
            index += list(range(start, start + block))
        index = index[:n]
        a, b = x[index], y[index]
        if a.std() > 0 and b.std() > 0:
            stats.append(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std()))
    return np.percentile(stats, [2.5, 97.5])


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(1)
    data = []
    for n, (name, h) in enumerate((("volume_delta", 1), ("volume_delta", 5), ("spread_abs", 1))):
        for t in range(45 + 3 * n):
            x = rng.gauss(0, 1)
            data.append(("A", t * 1000, h, 0.4 * x + rng.gauss(0, 1), name, name == "volume_delta", x))
    return spark.createDataFrame(data, "symbol string, timestamp_ms long, horizon long, y double, feature string, is_directional boolean, x double").repartition(4).cache()


@pytest.mark.parametrize("group_rows", [1000, 10])
def test_bootstrap_matches_brute_force(long, group_rows):
    got = {(r["feature"], r["horizon"]): (r["ci95_low"], r["ci95_high"]) for r in S.block_bootstrap(long, group_rows=group_rows).collect()}
    for (feature, horizon), part in long.toPandas().sort_values("timestamp_ms").groupby(["feature", "horizon"]):
        low, high = brute_interval(part["x"].tolist(), part["y"].tolist(), max(2 * horizon, 2))
        assert got[feature, horizon] == pytest.approx((low, high), abs=1e-9)


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 2.0, 2.0, 5.0)], "k string, v double")
    for layout in ("plain", "blocks"):
        assert rows(S.average_ranks(df, ["k"], "v", "r", layout).select("v", "r")) == [(1.0, 1.0), (2.0, 3.0), (2.0, 3.0), (2.0, 3.0), (5.0, 5.0)]


def test_deciles_put_remainders_like_integer_slices(spark):
    data = [("A", i, 1, float(i), "f", True, float(i)) for i in range(23)]
    df = spark.createDataFrame(data, "symbol string, timestamp_ms long, horizon long, y double, feature string, is_directional boolean, x double")
    got = S.deciles(df).first()
    for d in range(10):
        part = list(range(d * 23 // 10, (d + 1) * 23 // 10))
        assert got[f"decile_{d + 1}"] == pytest.approx(sum(part) / len(part))
    assert S.deciles(df.filter("x < 9")).count() == 0


@pytest.fixture(scope="module")
def grid(spark):
    """Imbalance foretells the next step, trade intensity does not; some seconds are missing."""
    rng = random.Random(4)
    mid, data = 100.0, []
    for t in range(400):
        signal = rng.choice([-1.0, 1.0])
        if t % 37:
            data.append(("A", t * 1000, 0.02, 0.0002, mid, mid + 0.001 * signal, signal * 0.5, signal * 0.3, None if t % 5 else rng.gauss(0, 1), rng.gauss(0, 1), rng.random(), rng.gauss(0, 1)))
        mid *= 1 + 0.0005 * signal
    return spark.createDataFrame(data, GRID)


def test_predictive_and_random_features_are_told_apart(grid):
    out = {(r["feature"], r["horizon"]): r for r in S.analyze(grid, (1, 5)).collect()}
    assert len(out) == 20
    good, noise = out["bid_ask_imbalance", 1], out["trade_intensity", 1]
    assert good["pearson"] > 0.99 and good["hit_rate"] == 1.0 and good["stable_sign"] and good["ci95_low"] > 0.9
    assert abs(noise["pearson"]) < 0.2 and noise["hit_rate"] is None and noise["ci95_low"] < 0 < noise["ci95_high"]
    assert good["n"] == sum(1 for t in range(399) if t % 37 and (t + 1) % 37) and out["bid_ask_imbalance", 5]["n_effective"] == out["bid_ask_imbalance", 5]["n"] // 5
    assert good["round_trip_cost"] == pytest.approx(0.0002 + 0.002 + 0.0006)


def test_blocks_agree_with_plain(grid):
    columns = ["feature", "horizon", "spearman", "decile_spread", "first_half", "second_half"]
    both = [rows(S.analyze(grid, (1,), layout=layout).select(*columns)) for layout in ("plain", "blocks")]
    assert both[0] == both[1]


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 10)] + [("b", 3.0)], "k string, v double")
    for layout in ("plain", "blocks"):
        got = {r["k"]: (r["lo"], r["mid"], r["hi"]) for r in S.exact_percentiles(df, ["k"], "v", {"lo": 0.0, "mid": 0.5, "hi": 0.9}, layout).collect()}
        assert got["a"] == pytest.approx(tuple(np.percentile([1, 2, 4, 10], [0, 50, 90]))) and got["b"] == (3.0, 3.0, 3.0)


def test_horizons_must_look_ahead(grid):
    with pytest.raises(ValueError):
        S.samples(grid, (0,))
