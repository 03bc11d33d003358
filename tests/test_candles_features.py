"""Candles and indicators against hand computation, prefixes and row order."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickloom.operators import candles as C
from tickloom.operators import features as X
from tickloom.operators import selection as J
from tickloom.operators import signals as S
from plain_indicators import SeriesState

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
DDL = "instrument string, timeframe string, open_time timestamp, close_time timestamp, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), volume decimal(18,8), is_closed boolean"


def minute(i, close, volume=100, name="BTC", closed=True, start=T0):
    a = start + timedelta(minutes=i)
    c = Decimal(str(round(close, 6)))
    return (name, "1m", a, a + timedelta(minutes=1), c, c + 1, c - 1, c, Decimal(str(volume)), closed)


def frame(spark, closes, volumes=None, **kw):
    return spark.createDataFrame([minute(i, c, (volumes or {}).get(i, 100), **kw) for i, c in enumerate(closes)], DDL)


def test_only_full_buckets_are_resampled(spark):
    src = spark.createDataFrame([minute(i, 10 + i, 10) for i in range(5)] + [minute(i, 10 + i, 10) for i in (5, 6, 8, 9)] + [minute(i, 50, 10) for i in range(12, 15)], DDL)
    got = C.resample(src, "1m", "5m").collect()
    assert len(got) == 1
    r = got[0]
    assert (float(r["open"]), float(r["high"]), float(r["low"]), float(r["close"]), float(r["volume"])) == (10.0, 15.0, 9.0, 14.0, 50.0)
    assert r["open_time"] == datetime(2024, 1, 1) and r["close_time"] == datetime(2024, 1, 1, 0, 5)
    derived = C.derive_timeframes(frame(spark, range(100, 160)), "1m")
    assert {r["timeframe"]: r["count"] for r in derived.groupBy("timeframe").count().collect()} == {"5m": 12, "15m": 4, "1h": 1}


@pytest.mark.parametrize("layout", ["plain", "blocks"])
def test_audit_names_each_kind_of_fault(spark, layout):
    order = [0, 1, 2, 2, 5, 4, 6]
    data = [(*minute(m, 10), n) for n, m in enumerate(order)]
    report = C.audit(spark.createDataFrame(data, DDL + ", seq long"), "1m", layout=layout).orderBy("seq").collect()
    assert [r["is_duplicate"] for r in report] == [False, False, False, True, False, False, False]
    assert [r["is_out_of_order"] for r in report] == [False] * 5 + [True, False]
    assert [r["missing"] for r in report] == [0, 0, 0, 0, 2, 0, 0]
    clean = C.validation_report(C.audit(frame(spark, [1, 2, 3]).withColumn("seq", F.unix_seconds("open_time")), "1m", layout=layout)).first()
    assert clean["is_clean"] and clean["total_missing"] == 0


def test_existing_rows_win_a_merge(spark):
    old, new = frame(spark, [1, 2, 3]), spark.createDataFrame([minute(2, 9), minute(3, 4), minute(3, 4)], DDL)
    merged = C.merge_incremental(old, new)
    assert [float(r["close"]) for r in merged.orderBy("open_time").collect()] == [1, 2, 3, 4]
    s = C.update_summary(merged).first()
    assert (s["candles_before"], s["candles_after"], s["candles_new"]) == (3, 4, 1)


def test_month_windows_clamp_the_day_and_keep_the_time(spark):
    ends = datetime(2024, 3, 31, 10, 30, tzinfo=timezone.utc)
    rows_ = []
    for a in (ends - timedelta(minutes=1), datetime(2024, 2, 29, 10, 30, tzinfo=timezone.utc), datetime(2023, 12, 31, 10, 30, tzinfo=timezone.utc), datetime(2023, 12, 31, 10, 29, tzinfo=timezone.utc)):
        rows_.append(("BTC", "1m", a, a + timedelta(minutes=1), *[Decimal(1)] * 5, True))
    got = {r["window"]: r["count"] for r in C.recent_windows(spark.createDataFrame(rows_, DDL)).groupBy("window").count().collect()}
    assert got == {"full": 4, "24m": 4, "12m": 4, "6m": 4, "3m": 3}


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(2)
    closes, price = [], 100.0
    for _ in range(150):
        price *= 1 + rng.gauss(0, 0.01)
        closes.append(round(price, 4))
    return closes, frame(spark, closes, {i: 50 + rng.randint(0, 100) for i in range(150)})


SHOWN = ["ret_1", "ret_60", "sma", "zscore", "percent_b", "bandwidth", "roc", "reg_slope", "reg_r2", "autocorrelation", "realized_volatility", "relative_volume", "ema", "atr", "rsi", "ewma_volatility"]


def shown(df):
    return df.select("close_time", *[F.round(c, 9).alias(c) for c in SHOWN])


def test_columns_match_the_bar_by_bar_state(walk):
    closes, df = walk
    got = X.feature_series(df).orderBy("close_time").collect()
    state, config = SeriesState(), X.FeatureConfig()
    for r in got:
        expect = state.advance(r["high"], r["low"], r["close"], r["volume"], config)
        for c in SHOWN:
            assert (r[c] is None) == (expect[c] is None), c
            assert r[c] is None or r[c] == pytest.approx(expect[c], rel=1e-8, abs=1e-11), c


def test_hand_values(spark):
    up = X.feature_series(frame(spark, [float(i) for i in range(1, 31)])).orderBy("close_time").collect()
    assert up[18]["sma"] is None and up[19]["sma"] == 10.5
    assert up[19]["reg_slope"] == pytest.approx(1) and up[19]["reg_intercept"] == pytest.approx(1) and up[19]["reg_r2"] == pytest.approx(1)
    assert up[13]["rsi"] is None and up[14]["rsi"] == 100.0
    assert up[12]["atr"] is None and up[13]["atr"] == pytest.approx(2.0)
    assert up[12]["roc"] == pytest.approx((13 - 1) / 1 * 100) and up[0]["ema"] == 1.0 and up[1]["ema"] == pytest.approx(1 + 2 / 21)
    flat = X.feature_series(frame(spark, [50.0] * 30)).orderBy(F.desc("close_time")).first()
    assert flat["rsi"] == 50.0 and flat["stddev"] == 0.0
    assert [flat[c] for c in ("zscore", "percent_b", "reg_r2", "reg_slope", "autocorrelation")] == [None] * 5


def test_no_feature_looks_ahead(walk):
    _, df = walk
    cut = df.filter("open_time < timestamp'2024-01-01 01:30'")
    assert set(rows(shown(X.feature_series(cut)))) <= set(rows(shown(X.feature_series(df))))


def test_row_order_and_partitioning_do_not_matter(walk):
    _, df = walk
    assert rows(shown(X.feature_series(df.orderBy(F.rand(3)).repartition(7)))) == rows(shown(X.feature_series(df)))


def test_blocks_match_plain(walk, monkeypatch):
    from tickloom.operators import series

    _, df = walk
    whole = rows(shown(X.feature_series(df, layout="plain")))
    monkeypatch.setattr(series.framed, "__kwdefaults__", {**series.framed.__kwdefaults__, "block_rows": 70})
    assert rows(shown(X.feature_series(df, layout="blocks"))) == whole


def test_open_bars_are_ignored(spark, walk):
    closes, df = walk
    extra = spark.createDataFrame([minute(150, 9999, closed=False)], DDL)
    assert X.feature_series(df.unionByName(extra)).count() == 150


def test_momentum_spans_one_bar_less_than_its_window(spark):
    rising = S.momentum(frame(spark, [100.0] * 9 + [101.0])).filter("entry IS NOT NULL").collect()
    assert [(r["entry"], r["confidence"]) for r in rising] == [("long", pytest.approx(0.2))]


def test_crossover_may_fire_on_the_second_bar_and_not_on_flat_series(spark):
    assert [r["entry"] for r in S.ema_crossover(frame(spark, [100.0, 101.0])).orderBy("ts").collect()] == [None, "long"]
    assert S.emitted(S.ema_crossover(frame(spark, [100.1] * 60))).count() == 0


def test_reversion_fires_against_the_move(spark):
    for jump, side in ((130.0, "short"), (70.0, "long")):
        got = S.emitted(S.mean_reversion(frame(spark, [100.0 + (i % 2) for i in range(19)] + [jump]))).collect()
        assert [r["direction"] for r in got] == [side]


def test_unknown_kind_is_named(walk):
    with pytest.raises(ValueError, match="nonsense"):
        S.candidates(walk[1], walk[1], ["nonsense"])


def sim(proposals, bypass, confirmations=3, revive=False):
    held, pending, count, out = None, None, 0, []
    for n, (p, b) in enumerate(zip(proposals, bypass)):
        if n == 0 or b or (revive and held is None and count == 0):
            held, count = p, 0
        elif p == held:
            count = 0
        else:
            count = count + 1 if count and pending == p else 1
            pending = p
            if count >= confirmations:
                held, count = p, 0
        out.append((held, count))
    return out


@pytest.mark.parametrize("revive", [False, True])
@pytest.mark.parametrize("layout", ["plain", "blocks"])
def test_damping_equals_the_state_machine(spark, revive, layout):
    rng = random.Random(9)
    data, expect = [], {}
    for k in range(12):
        p = [rng.choice(["a", "b", None] if revive else ["a", "b", "c"]) if rng.random() < 0.5 else "a" for _ in range(60)]
        for i in range(1, 60):
            if rng.random() < 0.55:
                p[i] = p[i - 1]
        b = [revive and rng.random() < 0.1 for _ in p]
        expect.update({(f"k{k}", i): v for i, v in enumerate(sim(p, b, revive=revive))})
        data += [(f"k{k}", i, x, y) for i, (x, y) in enumerate(zip(p, b))]
    df = spark.createDataFrame(data, "k string, i long, p string, b boolean")
    got = J.damped(df, ["k"], ["i"], "p", bypass=F.col("b"), revive=revive, layout=layout)
    assert {(r["k"], r["i"]): (r["held"], r["waiting"]) for r in got.collect()} == expect


def test_regimes(spark):
    names = ["reg_r2", "reg_slope", "autocorrelation", "bandwidth", "prev_bandwidth", "relative_volume", "percent_b"]
    cases = [(0.9, 1.0, 0.6, 0.1, 0.1, 1.0, 0.5), (0.1, 0.0, 0.1, 0.1, 0.1, 1.0, 0.5), (0.9, 1.0, 0.6, 0.2, 0.1, 2.0, 1.2), (0.2, 0.0, None, None, None, None, None), (0.45, 0.0, 0.1, 0.1, 0.1, 1.0, 0.5),
             (None,) * 7]
    got = J.classify_regime(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, " + ", ".join(f"{n} double" for n in names))).orderBy("i").collect()
    assert [r["regime"] for r in got] == ["trending", "ranging", "volatility_expansion", "ranging", "uncertain", "uncertain"]
    assert got[2]["regime_strength"] == pytest.approx(0.55 + 0.2 * 0.3 + 0.15) and got[1]["regime_strength"] == pytest.approx(0.9)


def test_batches_continue_from_a_bounded_state(spark):
    """Batches of any size give what one run over each whole series gives, and the state does not grow."""
    rng = random.Random(21)
    bars = []
    for key, n in (("A", 210), ("B", 40), ("C", 3)):
        price = 100.0
        for i in range(n):
            price *= 1 + rng.gauss(0, 0.01)
            bars.append((key, i, price, 50.0 + rng.randint(0, 100)))
    ddl = "instrument string, timeframe string, open_time timestamp, close_time timestamp, open double, high double, low double, close double, volume double"
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def frame(part):
        return spark.createDataFrame([(k, "1m", t0 + timedelta(minutes=i), t0 + timedelta(minutes=i + 1), p, p * 1.01, p * 0.99, p, v) for k, i, p, v in part], ddl)

    want = {}
    for key in "ABC":
        state = SeriesState()
        for k, i, p, v in bars:
            if k == key:
                want[k, i] = state.advance(p * 1.01, p * 0.99, p, v, X.FeatureConfig())
    state, seen = spark.createDataFrame([], X.STATE_DDL), 0
    for n, (a, b) in enumerate(((0, 30), (30, 31), (31, 150), (150, 151), (151, 210))):
        out, after = X.continued(frame([r for r in bars if a <= r[1] < b]), state, layout="blocks" if n == 2 else "plain")
        state = after.checkpoint()
        assert state.count() <= 3 * X.kept_bars(X.FeatureConfig())
        for r in out.collect():
            i = round((r.open_time.replace(tzinfo=timezone.utc) - t0).total_seconds()) // 60
            seen += 1
            for c in X.STREAMED:
                expect = want[r.instrument, i][c]
                assert (r[c] is None) == (expect is None) and (expect is None or r[c] == pytest.approx(expect, rel=1e-7, abs=1e-9)), (r.instrument, i, c, r[c], expect)
    assert seen == len(bars)
