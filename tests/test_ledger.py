"""Accounts from given fills, order columns and run reports, against plain loops and both layouts."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickloom.operators import accounts as A
from tickloom.operators import ledger as L
from tickloom.operators import sweep as W

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
FILL = "portfolio string, instrument string, at timestamp, fill_id long, side string, quantity decimal(18,8), price decimal(18,8), fee decimal(18,8)"
KEY = ["portfolio", "instrument"]


@pytest.fixture(scope="module")
def given():
    """Random fills: turns, repeated sells and buys that nothing closes, equal times, null portfolios."""
    rng = random.Random(3)
    out = []
    for i in range(400):
        out.append((rng.choice(["p", "p", "p", "q", None]), rng.choice("abc"), T0 + timedelta(hours=i // 3), i, rng.choice(["buy", "sell"]), Decimal(rng.randint(1, 3)), Decimal(rng.randint(900, 1100)) / 10, Decimal(rng.randint(0, 9)) / 100))
    return out


@pytest.fixture(scope="module")
def fills(spark, given):
    return spark.createDataFrame(given, FILL).repartition(4).cache()


def plain(given, cash=1000):
    """Per fill the state of its portfolio before and after, by a loop; and the closed positions."""
    last, state = {}, defaultdict(lambda: {"cash": Decimal(cash), "cost": Decimal(0), "n": 0, "net": Decimal(0), "held": Decimal(0)})
    before, after, done = {}, {}, []
    for p, i, at, n, side, q, price, fee in sorted(given, key=lambda f: (f[2], f[3])):
        s, prev = state[p], last.get((p, i))
        before[n] = dict(s)
        if side == "buy":
            s["cash"] -= q * price + fee
            s["cost"] += q * price
            s["n"] += 1
            s["held"] += q
        elif prev and prev[0] == "buy":
            _, pq, pprice, pfee, pn, pat = prev
            s["cash"] += pq * price - fee
            s["cost"] -= pq * pprice
            s["n"] -= 1
            s["held"] -= pq
            s["net"] += pq * (price - pprice) - fee - pfee
            done.append((p, i, pn, pq, pprice, price, pq * (price - pprice), pq * (price - pprice) - fee - pfee))
        last[p, i] = (side, q, price, fee, n, at)
        after[n] = dict(s)
    return before, after, done


@pytest.mark.parametrize("layout", ["plain", "blocks"])
def test_paths_against_a_loop(fills, given, layout):
    before, after, done = plain(given)
    for inclusive, want in ((True, after), (False, before)):
        got = A.account_path(fills, ["portfolio"], KEY, 1000.0, inclusive=inclusive, layout=layout).collect()
        assert {r.fill_id: (r.cash, r.exposure, r.open_positions, r.realized_pnl, r.held) for r in got} == {n: (s["cash"], s["cost"], s["n"], s["net"], s["held"]) for n, s in want.items()}
    got = A.closed(fills, KEY, layout).collect()
    assert sorted(((r.portfolio, r.instrument, r.position_id, r.quantity, r.entry_price, r.exit_price, r.pnl_gross, r.pnl_net) for r in got), key=str) == sorted(done, key=str)
    assert A.opened(fills, KEY).count() == sum(f[4] == "buy" for f in given)


@pytest.mark.parametrize("layout", ["plain", "blocks"])
def test_entry_limits_in_order(fills, given, layout):
    config = L.RiskConfig(initial_cash=3000.0, max_open_positions=8, max_total_exposure=1500.0, max_daily_loss=15.0)
    before, _, _ = plain(given, 3000)
    today, want, last = defaultdict(Decimal), {}, {}
    for p, i, at, n, side, q, price, fee in sorted(given, key=lambda f: (f[2], f[3])):
        s, day = before[n], (p, at.date())
        if side == "buy":
            value = q * price
            want[n] = ("max_open_positions_reached" if s["n"] >= 8 else "daily_loss_limit_breached" if today[day] < 0 and -today[day] >= 15 else "exposure_limit_exceeded" if s["cost"] + value > 1500
                       else "insufficient_balance" if s["cash"] < value else None)
        elif last.get((p, i), ("",))[0] == "buy":
            _, pq, pprice, pfee = last[p, i]
            today[day] += pq * (price - pprice) - fee - pfee
        last[p, i] = (side, q, price, fee)
    got = {r.fill_id: r.reason for r in A.entry_limits(fills, ["portfolio"], KEY, config, layout).collect()}
    assert got == want and len(set(want.values())) >= 3


def test_equity_marks_what_is_held(spark, fills, given):
    marks = spark.createDataFrame([(p, i, T0 + timedelta(hours=h, minutes=30), Decimal(100 + h)) for p in ("p", "q", None, "new") for i in "abc" for h in (-1, 10, 77, 500)],
                                  "portfolio string, instrument string, ts timestamp, price decimal(18,8)")
    got = A.equity_points(fills, marks, KEY, 1000.0).collect()
    assert len(got) == 48
    for r in got:
        own = [f for f in given if (f[0], f[1]) == (r.portfolio, r.instrument) and f[2].replace(tzinfo=None) <= r.ts]
        _, after, _ = plain(own)
        s = list(after.values())[-1] if own else {"cash": Decimal(1000), "cost": Decimal(0), "held": Decimal(0), "net": Decimal(0)}
        assert (r.cash, r.exposure, r.held, r.realized_pnl) == (s["cash"], s["cost"], s["held"], s["net"])
        assert r.equity == s["cash"] + s["held"] * r.price and r.unrealized_pnl == s["held"] * r.price - s["cost"]


def test_routing_reasons(spark, fills):
    c = spark.createDataFrame([("p", "a", T0 - timedelta(days=1), "long"), ("p", "a", T0 - timedelta(days=1), "short"), ("new", "a", T0, "short")], "portfolio string, instrument string, ts timestamp, direction string")
    assert sorted((r.direction, r.reason) for r in A.routed(c, fills, KEY).collect()) == [("long", None), ("short", "short_selling_not_supported"), ("short", "short_selling_not_supported")]
    one = fills.filter("portfolio = 'p' and side = 'buy'")
    held = A.routed(c.withColumn("ts", F.lit(T0 + timedelta(days=30))), one, KEY)
    assert sorted((r.portfolio, r.direction, r.reason) for r in held.collect()) == [("new", "short", "short_selling_not_supported"), ("p", "long", "position_already_open"), ("p", "short", None)]


@pytest.mark.parametrize("last, reason", [("95", "stop_loss"), ("110", "take_profit"), ("95.01", None), ("109.99", None)])
def test_limits_are_inclusive_and_come_in_order(spark, last, reason):
    held = spark.createDataFrame([("a", "buy", Decimal(100), f, s) for f in (False, True) for s in (False, True)], "instrument string, side string, entry_price decimal(18,8), force_exit boolean, signal_exit boolean")
    marks = spark.createDataFrame([("a", Decimal(last))], "instrument string, mark decimal(18,8)")
    got = {(r.force_exit, r.signal_exit): r.reason for r in A.exit_choice(held, marks).collect()}
    want = {(True, False): "strategy_switch", (True, True): "strategy_switch", (False, True): reason or "signal", (False, False): reason}
    assert got == {k: v for k, v in want.items() if v}


def test_order_costs_and_next_open(spark):
    bars = spark.createDataFrame([("BTC", "1h", T0 + timedelta(hours=h), T0 + timedelta(hours=h + 1), Decimal(o), Decimal(c)) for h, (o, c) in enumerate([(100, 100), (102, 103), (104, 104)])],
                                 "instrument string, timeframe string, open_time timestamp, close_time timestamp, open decimal(18,8), close decimal(18,8)")
    assert [(r.close, r.fill_price) for r in L.next_bar_fills(bars).orderBy("close_time").collect()] == [(100, 102), (103, 104), (104, None)]
    signals = bars.select("instrument", "timeframe", F.lit("s").alias("strategy_id"), F.col("close_time").alias("ts"), F.lit("long").alias("entry"), F.lit(False).alias("manages_exit"), F.lit(False).alias("exit_long"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("metadata"))
    units = spark.createDataFrame([("BTC", Decimal("0.01"), Decimal("0.0001"), Decimal("0.0001"), Decimal(10))], "instrument string, tick decimal(18,8), lot decimal(18,8), min_quantity decimal(18,8), min_notional decimal(18,8)")
    first = L.ledger_rows(bars, signals, units).orderBy("close_time").first()
    assert (first["quantity"], first["order_value"], first["_buy"], first["_sell"], first["size_reason"]) == (10, 1000, Decimal("100.05"), Decimal("99.95"), None)


def test_reports_cover_every_run(spark):
    rng = random.Random(5)
    data = [(i, "GOOD", "1h", rng.choice(["momentum", "quant_momentum"]), T0 + timedelta(days=i * 3), T0 + timedelta(days=i * 3 + 2), "closed", Decimal(rng.randint(-50, 60)), Decimal(1)) for i in range(300)]
    trades = spark.createDataFrame(data, "position_id long, symbol string, timeframe string, strategy_id string, opened_at timestamp, closed_at timestamp, status string, pnl_gross decimal(18,5), fees_paid decimal(18,5)")
    trades = trades.withColumns({"pnl_net": F.col("pnl_gross") - F.col("fees_paid"), "spread_paid": F.col("fees_paid"), "slippage_paid": F.col("fees_paid"), "side": F.lit("buy")})
    cut = W.trades_by_window(trades)
    slices = cut.groupBy(*W.SLICE).agg(F.count(F.lit(1)).alias("slice_trades"))
    plain_, blocks = (W.experiment_reports(cut, slices, 100_000.0, layout=x) for x in ("plain", "blocks"))
    shown = [*W.RUN, "total_trades", "net_pnl", "max_drawdown", "net_return_pct", "slice_trades"]
    assert rows(plain_.select(*shown)) == rows(blocks.select(*shown)) and plain_.count() == 6 * 5
    end = max(d[5] for d in data)
    traded = {(r["window"], r.strategy_id): r.total_trades for r in plain_.collect()}
    assert traded["full", "momentum"] == sum(d[3] == "momentum" for d in data) and traded["full", "mean_reversion"] == 0
    assert 0 < traded["12m", "momentum"] == sum(d[3] == "momentum" and d[4] >= end.replace(year=end.year - 1) for d in data)
    graded = W.diagnostics(plain_)
    assert {r["class"] for r in graded.collect()} <= {"LOW_SAMPLE", "NO_EDGE", "FRICTION_LIMITED", "NET_POSITIVE"}
    assert W.pairs(graded).count() == 3 * 5 and W.consistency(graded).filter("consistent").count() > 0


def test_reports_say_what_they_ran_on(spark):
    def bar(symbol, arrived, day, close):
        return (symbol, "1d", T0 + timedelta(days=day), T0 + timedelta(days=day + 1), Decimal(close), True, arrived)

    start = T0.replace(tzinfo=None)
    # GOOD is whole; HOLE lacks two days, has one bar twice and one that came late.
    days = [(0, 100), (1, 110), (2, 120), (5, 90), (5, 90), (4, 80)]
    data = [bar("GOOD", d, d, 50 + d) for d in range(200)] + [bar("HOLE", i, d, c) for i, (d, c) in enumerate(days)]
    bars = spark.createDataFrame(data, "instrument string, timeframe string, open_time timestamp, close_time timestamp, close decimal(18,8), is_closed boolean, seq long")
    for layout in ("plain", "blocks"):
        cut = W.windowed(bars)
        kept, skipped, report = W.strict(cut, "1d", layout, seq="seq")
        assert {r.symbol for r in kept.collect()} == {"GOOD"} and {r.symbol for r in skipped.collect()} == {"HOLE"} and skipped.count() == 5
        ran = W.run_data(cut, report)
        hole = ran.filter("symbol = 'HOLE' AND window = 'full'").first()
        assert (hole.candles_used, hole.gap_count, hole.total_missing, hole.duplicate_count, hole.out_of_order_count) == (6, 1, 2, 1, 1)
        assert (hole.period_start, hole.period_end, round(hole.benchmark_return, 9)) == (start, start + timedelta(days=6), -0.1)
        short = ran.filter("symbol = 'GOOD' AND window = '3m'").first()
        assert short.is_clean and short.period_end == start + timedelta(days=200) and short.candles_used < 95
        first = short.period_start
        times = [(first - timedelta(days=1), first + timedelta(days=1)), (first, first + timedelta(days=1)), (short.period_end - timedelta(days=1), short.period_end), (short.period_end - timedelta(days=1), short.period_end + timedelta(days=1))]
        trades = spark.createDataFrame([(i, "GOOD", "1d", "momentum", a, b, "closed", Decimal(3), Decimal(1), Decimal(2), Decimal(0), Decimal(0)) for i, (a, b) in enumerate(times)],
                                       "position_id long, symbol string, timeframe string, strategy_id string, opened_at timestamp, closed_at timestamp, status string, pnl_gross decimal(18,5), fees_paid decimal(18,5), "
                                       "pnl_net decimal(18,5), spread_paid decimal(18,5), slippage_paid decimal(18,5)").withColumn("side", F.lit("buy"))
        within = W.trades_in_slices(trades, ran)
        assert sorted(r.position_id for r in within.filter("window = '3m'").collect()) == [1, 2] and within.filter("window = 'full'").count() == 3
        out = W.experiment_reports(within, ran, 1000.0, ["momentum", "mean_reversion"], layout=layout)
        assert out.count() == 2 * 5 * 2
        none = out.filter("symbol = 'HOLE' AND window = 'full' AND strategy_id = 'momentum'").first()
        assert (none.total_trades, none.gap_count, none.positive_days, none.max_drawdown_pct, none.profit_factor) == (0, 1, 0, 0.0, None)
        some = out.filter("symbol = 'GOOD' AND window = '3m' AND strategy_id = 'momentum'").first()
        assert (some.total_trades, some.net_return_pct, some.gross_return_pct, some.positive_days) == (2, 0.004, 0.006, 2)
    empty = W.experiment_reports(within.limit(0), ran, 1000.0, ["momentum"])
    assert {r.total_trades for r in empty.collect()} == {0} and empty.count() == 10
