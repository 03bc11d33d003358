"""Blocked execution must give exactly what one window over the whole key gives."""

import math
import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import series as S


@pytest.fixture(scope="module")
def walk(spark):
    """One hot key with most rows, several small ones; order column with a tie-break."""
    rng = random.Random(7)
    data = [("hot", i // 3, i, rng.random() * 10, None if rng.random() < 0.3 else rng.random()) for i in range(700)]
    data += [(f"k{i % 7}", i, i, rng.random(), None if rng.random() < 0.5 else 1.0 * i) for i in range(120)]
    data += [(None, i // 2, i, rng.random(), None if rng.random() < 0.5 else 1.0 * i) for i in range(90)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, t long, id long, v double, o double").repartition(5).cache()


def test_positions_are_dense_and_ordered(walk):
    expect = walk.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).cast("long"))
    got = S.positions(walk, ["k"], ["t", "id"], "blocks", name="p")
    assert rows(got.select("k", "id", "p")) == rows(expect.select("k", "id", "p"))


def test_framed_blocks_match_plain(walk):
    def build(df, w):
        return df.select("k", "id", F.sum("v").over(w.rowsBetween(-4, 0)).alias("s"), F.count("v").over(w.rowsBetween(-4, 0)).alias("n"), F.lead("v", 2).over(w).alias("next"), *_home(df))

    def _home(df):
        return [F.col(c) for c in ("_home", "_block", "_pos") if c in df.columns]

    plain = S.framed(walk, ["k"], ["t", "id"], build, back=4, ahead=2, layout="plain")
    for size in (5, 16, 64):
        blocks = S.framed(walk, ["k"], ["t", "id"], build, back=4, ahead=2, layout="blocks", block_rows=size)
        assert rows(blocks.select("k", "id", "s", "n", "next")) == rows(plain.select("k", "id", "s", "n", "next"))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_blocks_match_plain(walk, inclusive):
    specs = {
        "total": ("sum", F.col("o").cast("decimal(18,6)")), "top": ("max", F.col("o")), "low": ("min", F.col("o")), "n": ("count", F.col("o")), "latest": ("last", F.struct("o", "id")),
        "known": ("last", F.col("o")),
    }
    plain = S.running(walk, ["k"], ["t", "id"], specs, inclusive=inclusive, layout="plain").select("k", "id", *specs)
    for size in (3, 50):
        blocks = S.running(walk, ["k"], ["t", "id"], specs, inclusive=inclusive, layout="blocks", block_rows=size).select("k", "id", *specs)
        assert rows(blocks) == rows(plain)


def reference_scan(values, alpha, start, seed):
    out, state = [], None
    for n, x in enumerate(values, 1):
        first = start + seed - 1
        if n == first:
            state = sum(values[start - 1:first]) / seed
        elif n > first:
            state += alpha * (x - state)
        out.append(None if n < first else state)
    return out


@pytest.mark.parametrize("layout", ["plain", "blocks"])
def test_recursions_match_one_by_one(walk, layout):
    specs = {"e": S.Recursion(F.col("v"), 2 / 13), "w": S.Recursion(F.col("v"), 1 / 14, start=2, seed_rows=14)}
    got = S.recursions(walk, ["k"], ["t", "id"], specs, layout=layout, span=32).toPandas()
    for _, part in got.sort_values(["t", "id"]).groupby("k"):
        values = part["v"].tolist()
        for name, s in specs.items():
            expect = reference_scan(values, s.alpha, s.start, s.seed_rows)
            for a, b in zip(part[name].tolist(), expect):
                assert (b is None and (a is None or math.isnan(a))) or a == pytest.approx(b, rel=1e-11)


def test_recursion_keeps_the_ratio_of_two_decaying_averages(spark):
    """Thousands of flat bars: both averages shrink alike and must not drop to zero at block ends."""
    moves = [1.0, 0.0, 2.0] + [0.0] * 1500
    falls = [0.5, 1.0, 0.0] + [0.0] * 1500
    df = spark.createDataFrame([("a", i, u, d) for i, (u, d) in enumerate(zip(moves, falls))], "k string, t long, u double, d double")
    got = S.recursions(df, ["k"], ["t"], {"g": S.Recursion(F.col("u"), 1 / 14), "l": S.Recursion(F.col("d"), 1 / 14)}, layout="plain", span=64)
    last = got.orderBy(F.desc("t")).first()
    assert last["g"] > 0 and last["g"] / last["l"] == pytest.approx(reference_scan(moves, 1 / 14, 1, 1)[-1] / reference_scan(falls, 1 / 14, 1, 1)[-1], rel=1e-9)


def test_as_of_takes_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), ("b", 9, "z"), ("a", 7, "w")], "k string, at long, name string")
    right = spark.createDataFrame([("a", 5, 1, 50), ("a", 5, 2, 51), ("a", 2, 1, 20), ("b", 10, 1, 100)], "k string, ts long, seq long, v long")
    for layout in ("plain", "blocks"):
        got = S.as_of(left, right, ["k"], "at", "ts", ["v"], ["seq"], layout=layout)
        assert {r["name"]: r["v"] for r in got.collect()} == {"x": 51, "y": None, "z": None, "w": 51}


def test_layout_is_chosen_by_the_largest_key(walk, monkeypatch):
    assert S.measured_layout(walk, ["k"]) == "plain"
    monkeypatch.setattr(S, "PLAIN_LIMIT", 100)
    assert S.measured_layout(walk, ["k"], limit=100) == "blocks"


def test_plain_plan_has_one_exchange(walk):
    def build(df, w):
        return df.withColumns({"a": F.avg("v").over(w.rowsBetween(-4, 0)), "b": F.max("v").over(w.rowsBetween(-19, 0))})

    plan = S.framed(walk, ["k"], ["t", "id"], build, back=19, layout="plain")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_null_keys_stay_in_both_layouts(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), (None, 1, 5.0), (None, 2, 7.0)], "k string, t long, v double")
    want = [("a", 1, 1.0), ("a", 2, 3.0), (None, 1, 5.0), (None, 2, 12.0)]
    for layout in ("plain", "blocks"):
        got = S.running(df, ["k"], ["t"], {"s": ("sum", F.col("v"))}, layout=layout, block_rows=1)
        assert sorted(((r.k, r.t, r.s) for r in got.collect()), key=str) == sorted(want, key=str)
    found = S.as_of(df, df.select("k", "t", F.col("v").alias("w")), ["k"], "t", "t", ["w"])
    assert sorted(((r.k, r.v, r.w) for r in found.collect()), key=str) == sorted([(k, v, v) for k, _, v in df.collect()], key=str)


def test_frames_and_seeds_longer_than_a_block(spark):
    df = spark.createDataFrame([("a", i, float(i % 7)) for i in range(5000)], "k string, t long, v double").repartition(3)

    def build(d, w):
        return d.withColumn("s", F.sum("v").over(w.rowsBetween(-299, 0)))

    plain, blocks = (S.framed(df, ["k"], ["t"], build, back=299, layout=layout, block_rows=100) for layout in ("plain", "blocks"))
    assert rows(plain.select("t", "s")) == rows(blocks.select("t", "s"))
    slow = S.Recursion(F.col("v"), 2 / 3001, seed_rows=3000)
    got = {r.t: (r.slow, r.fast) for r in S.recursions(df, ["k"], ["t"], {"slow": slow, "fast": S.Recursion(F.col("v"), 0.5)}).collect()}
    state, fast = None, None
    for i in range(5000):
        x = float(i % 7)
        fast = x if fast is None else fast + 0.5 * (x - fast)
        state = sum(float(j % 7) for j in range(3000)) / 3000 if i == 2999 else None if i < 2999 else state + 2 / 3001 * (x - state)
        assert got[i][1] == pytest.approx(fast) and (got[i][0] is None if state is None else got[i][0] == pytest.approx(state))


def test_operators_start_no_job_in_the_plain_layout(walk, spark):
    tracker, group = spark.sparkContext.statusTracker(), "no-job"
    spark.sparkContext.setJobGroup(group, group)
    S.running(walk, ["k"], ["t", "id"], {"s": ("sum", F.col("v"))}, layout="plain")
    S.as_of(walk, walk.select("k", "t", "id", "o"), ["k"], "t", "t", ["o"], ["id"], layout="plain")
    assert tracker.getJobIdsForGroup(group) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_runs_share_blocks_and_know_the_row_before(spark):
    from tickloom.operators import series as Z

    df = spark.range(1, 500).select((F.col("id") % 2).alias("k"), "id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    specs = {"total": ("sum", F.col("v")), "before": ("previous", F.struct("v"))}
    plain = Z.running(df, ["k"], ["id"], specs, layout="plain")
    placed = Z.positions(df, ["k"], ["id"]).withColumn(Z.RUN, F.expr("(_pos - 1) div 7"))
    once = Z.running(placed, ["k"], ["id"], specs, block_rows=7)
    assert rows(once.select(plain.columns)) == rows(plain) and Z.RUN in once.columns
    twice = Z.running(once, ["k"], ["id"], {"most": ("max", F.col("total"))}, block_rows=7)
    # Rows are shuffled to their blocks once for both runs.
    assert twice._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(twice.select("k", "id", "most")) == rows(Z.running(plain, ["k"], ["id"], {"most": ("max", F.col("total"))}, layout="plain").select("k", "id", "most"))
