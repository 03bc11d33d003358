"""Order books: sequencing, blocks against one fold, and the grid."""

import random
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickloom.operators import books as B

LEVEL = "array<struct<price:decimal(18,8),quantity:decimal(18,8)>>"
SNAP = f"symbol string, last_update_id long, captured_at_ms long, bids {LEVEL}, asks {LEVEL}"
DELTA = f"symbol string, first_update_id long, final_update_id long, event_time_ms long, bids {LEVEL}, asks {LEVEL}"
TRADE = "symbol string, trade_id long, timestamp_ms long, quantity decimal(18,8), is_buy boolean"


def lv(*pairs):
    return [(Decimal(str(p)), Decimal(str(q))) for p, q in pairs]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([("S", 10, 1000, lv((100, 1), (99, 2), (98, 3)), lv((101, 1), (102, 2), (103, 3)))], SNAP)


def statuses(seq):
    return [r["status"] for r in seq.orderBy("_pos").collect()]


def test_stale_gap_and_recovery(spark, base):
    later = spark.createDataFrame([("S", 20, 2000, lv((90, 1)), lv((91, 1)))], SNAP)
    deltas = spark.createDataFrame(
        [("S", 5, 9, 900, lv(), lv()), ("S", 11, 11, 1100, lv((100, 0)), lv()), ("S", 11, 11, 1150, lv(), lv()), ("S", 14, 14, 1200, lv(), lv()), ("S", 15, 15, 1300, lv(), lv()),
         ("S", 21, 21, 2100, lv((90.5, 4)), lv())], DELTA)
    seq = B.sequence(B.merge_events(base.unionByName(later), deltas))
    assert statuses(seq) == ["snapshot", "applied", "stale", "gap", "broken", "snapshot", "applied"]
    assert rows(B.gaps(seq)) == [("S", 12, 14, 1200)]
    best = {r["uid"]: (r["best_bid"], r["best_ask"]) for r in B.quotes(seq).collect()}
    assert best == {10: (100.0, 101.0), 11: (99.0, 101.0), 20: (90.0, 91.0), 21: (90.5, 91.0)}


def test_zero_quantity_deletes_and_new_levels_join(spark, base):
    deltas = spark.createDataFrame([("S", 11, 11, 1100, lv((100, 0), (99.5, 7)), lv((100.5, 2)))], DELTA)
    q = B.quotes(B.sequence(B.merge_events(base, deltas))).filter("uid = 11").first()
    assert (q["best_bid"], q["bid_qty"], q["best_ask"], q["ask_qty"]) == (99.5, 7.0, 100.5, 2.0)
    assert (q["bid_depth"], q["ask_depth"]) == (12.0, 8.0)


@pytest.fixture(scope="module")
def feed(spark):
    """Two symbols, one with most events; snapshots now and then, several levels per update."""
    rng = random.Random(3)
    snaps, deltas, trades, ids, clock = [], [], [], {"A": 0, "B": 0}, 0
    for n in range(600):
        s = "A" if rng.random() < 0.8 else "B"
        ids[s] += 1
        clock += rng.choice([0, 1, 40, 900, 7000])
        side = lambda sign: lv(*[(100 + sign * rng.randint(1, 12) * 0.5, rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(0, 3))])
        if n < 4 or rng.random() < 0.02:
            snaps.append((s, ids[s], clock, lv((99.5, 1), (99, 2)), lv((100.5, 1), (101, 2))))
        else:
            deltas.append((s, ids[s], ids[s], clock, side(-1), side(1)))
        if rng.random() < 0.5:
            trades.append((s, n, clock + rng.choice([0, 0, 3]), Decimal(rng.randint(1, 9)), rng.random() < 0.5))
    return spark.createDataFrame(snaps, SNAP), spark.createDataFrame(deltas, DELTA), spark.createDataFrame(trades, TRADE)


def test_blocks_do_not_change_the_book(feed, monkeypatch):
    snaps, deltas, _ = feed
    whole = B.quotes(B.sequence(B.merge_events(snaps, deltas), "plain")).select("symbol", "uid", *B.QUOTES)
    for levels in (7, 40):
        monkeypatch.setattr(B, "BLOCK_LEVELS", levels)
        seq = B.sequence(B.merge_events(snaps, deltas), "blocks")
        assert seq.select("symbol", "_block").distinct().count() > 10
        assert rows(B.quotes(seq).select("symbol", "uid", *B.QUOTES)) == rows(whole)


def brute_series(snaps, deltas, trades, window):
    """Event by event with a dict per side, as a check on the relational form."""
    out = {}
    for symbol in ("A", "B"):
        book = [(r["last_update_id"], 0, r["captured_at_ms"], r) for r in snaps.collect() if r["symbol"] == symbol]
        seed = min(b[0] for b in book)
        book += [(r["final_update_id"], 1, r["event_time_ms"], r) for r in deltas.collect() if r["symbol"] == symbol and r["final_update_id"] > seed]
        tape = sorted((r["timestamp_ms"], float(r["quantity"]), r["is_buy"]) for r in trades.collect() if r["symbol"] == symbol)
        sides, prev, flow, eff = {"bids": {}, "asks": {}}, None, [], 0
        for uid, kind, ms, row in sorted(book, key=lambda b: b[:2]):
            eff = max(eff, ms)
            if kind == 0:
                sides = {"bids": {}, "asks": {}}
            for s in sides:
                for p, q in row[s]:
                    sides[s].pop(float(p), None)
                    if q > 0:
                        sides[s][float(p)] = float(q)
            best = None
            if sides["bids"] and sides["asks"]:
                b, a = max(sides["bids"]), min(sides["asks"])
                best = (b, sides["bids"][b], a, sides["asks"][a])
            if prev and best:
                (pb, pbq, pa, paq), (b, bq, a, aq) = prev, best
                flow.append((eff, (bq if b >= pb else 0) - (pbq if b <= pb else 0) - ((aq if a <= pa else 0) - (paq if a >= pa else 0))))
            prev = best
            seen = [x for x in tape if x[0] < eff and eff - x[0] <= window * 1000]
            rolled = [x for t, x in flow if eff - t <= window * 1000]
            out[symbol, uid] = (
                sum(q if up else -q for _, q, up in seen) if seen else None, len(seen) / window if seen else None, sum(rolled) if rolled else None)
    return out


@pytest.mark.parametrize("layout", ["plain", "blocks"])
def test_series_matches_event_by_event(feed, layout):
    snaps, deltas, trades = feed
    got = B.micro_series(B.quotes(B.sequence(B.merge_events(snaps, deltas), layout)), trades, 30, layout)
    expect = brute_series(snaps, deltas, trades, 30)
    found = {(r["symbol"], r["uid"]): (r["volume_delta"], r["trade_intensity"], r["order_flow_imbalance"]) for r in got.collect()}
    assert found.keys() == expect.keys()
    for k, v in expect.items():
        assert found[k] == pytest.approx(v) or found[k] == v


def test_grid_holds_last_state_and_never_looks_ahead(spark, base):
    deltas = spark.createDataFrame([("S", 11, 11, 3500, lv((100, 5)), lv()), ("S", 12, 12, 5000, lv((100.4, 1)), lv()), ("S", 13, 13, 5000, lv((100.6, 1)), lv())], DELTA)
    trades = spark.createDataFrame([("S", 1, 2000, Decimal(4), True), ("S", 2, 2000, Decimal(1), False)], TRADE)
    for layout in ("plain", "blocks"):
        seq = B.sequence(B.merge_events(base, deltas), layout)
        grid = {r["timestamp_ms"]: r for r in B.feature_grid(seq, B.quotes(seq), trades, 1, 30, layout).collect()}
        assert sorted(grid) == [1000, 2000, 3000, 4000, 5000]
        assert [grid[t]["mid_price"] for t in sorted(grid)] == [100.5, 100.5, 100.5, 100.5, pytest.approx(100.7)]
        # Only the first event of a millisecond is in the point at that millisecond.
        assert grid[2000]["volume_delta"] == 4.0 and grid[3000]["volume_delta"] == 3.0
        assert grid[1000]["volume_delta"] is None and grid[4000]["order_flow_imbalance"] == 4.0


def test_prefix_of_the_feed_gives_a_prefix_of_the_series(feed):
    snaps, deltas, trades = feed
    early = lambda df, c: df.filter(F.col(c) < 900_000)
    full = B.micro_series(B.quotes(B.sequence(B.merge_events(snaps, deltas))), trades, 30, "plain")
    cut = B.micro_series(B.quotes(B.sequence(B.merge_events(early(snaps, "captured_at_ms"), early(deltas, "event_time_ms")))), early(trades, "timestamp_ms"), 30, "plain")
    assert set(rows(cut)) <= set(rows(full)) and cut.count() > 50


def test_round_trip_of_level_rows(feed):
    snaps, deltas, _ = feed
    again = B.rebuild_snapshots(B.flatten_levels(snaps, ["symbol", "last_update_id", "captured_at_ms"]))
    assert rows(again.select(*snaps.columns)) == rows(snaps)
    kept = deltas.filter("size(bids) + size(asks) > 0")
    again = B.regroup_deltas(B.flatten_levels(kept, ["symbol", "first_update_id", "final_update_id", "event_time_ms"]))
    assert rows(again.select(*kept.columns)) == rows(kept)


def test_streamed_book_goes_on_across_batches(spark):
    """Three batches give the rows of one: the book, the order flow and the tape of a window are carried, gaps are found."""
    from tickloom.session import scratch_path
    from tickloom.streaming import jobs as J

    rng = random.Random(8)
    ids, ms, events = 0, 1000, []
    for n in range(240):
        ids += 2 if n in (90, 200) else 1
        ms += rng.choice([0, 400, 2500, -300])
        if n % 60 == 5 or n == 0:
            events.append(("S", 0, ids, ids, ms, lv((100, 1 + n), (99, 2)), lv((101, 3), (102, n + 1)), None, None))
        else:
            bid = rng.random() < 0.5
            level = lv(((100 if bid else 101) + (rng.randint(-3, 0) if bid else rng.randint(0, 3)), rng.randint(0, 5)))
            events.append(("S", 1, ids, ids, ms, level if bid else [], [] if bid else level, None, None))
        events.append(("S", 2, n, n, ms + rng.randint(-50, 50), [], [], float(rng.randint(1, 9)), rng.random() < 0.5))
    ddl = f"symbol string, kind int, uid long, first_uid long, t long, bids {LEVEL}, asks {LEVEL}, quantity double, is_buy boolean"

    def played(parts):
        path = scratch_path(spark, "book-sink")
        for n, part in enumerate(parts):
            write = J.book_sink(path, 30, layout="plain" if n == 1 else "blocks")
            for _ in range(2 if n == 1 else 1):
                write(spark.createDataFrame(part, ddl), n)
        return spark.read.parquet(f"{path}/rows").drop("batch")

    # Trades come with the book events after them, as in one batch.
    books_of, trades_of = [e for e in events if e[1] != 2], [e for e in events if e[1] == 2]
    parts = [books_of[:97] + trades_of, books_of[97:150], books_of[150:]]
    whole, cut = played([events]), played(parts)
    assert rows(cut) == rows(whole)
    assert cut.filter("status = 'gap'").count() == 2 and cut.filter("status = 'unseeded'").count() > 0
    s = spark.createDataFrame([(e[0], e[2], e[4], e[5], e[6]) for e in books_of if e[1] == 0], SNAP)
    d = spark.createDataFrame([(e[0], e[3], e[2], e[4], e[5], e[6]) for e in books_of if e[1] == 1], DELTA)
    t = spark.createDataFrame([(e[0], e[2], e[4], Decimal(e[7]), e[8]) for e in trades_of], TRADE)
    batch = B.micro_series(B.quotes(B.sequence(B.merge_events(s, d))), t, 30)
    columns = [c for c in cut.columns if c != "status"]
    assert rows(cut.filter("status = 'applied'").select(columns)) == rows(batch.select(columns))


def test_streamed_book_is_linear(spark):
    """A window of thousands of trades is not gone through at every event."""
    import time

    from tickloom.session import scratch_path
    from tickloom.streaming import jobs as J

    n = F.col("id")
    side = F.array(F.struct(F.lit(100).cast("decimal(18,8)").alias("price"), (n % 7 + 1).cast("decimal(18,8)").alias("quantity")))
    none = F.array().cast(side_type := "array<struct<price:decimal(18,8),quantity:decimal(18,8)>>")
    book = spark.range(20000).select(F.lit("S").alias("symbol"), F.when(n == 0, 0).otherwise(1).alias("kind"), n.alias("uid"), n.alias("first_uid"), n.alias("t"), side.cast(side_type).alias("bids"),
                                     none.alias("asks"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("boolean").alias("is_buy"))
    tape = book.withColumns({"kind": F.lit(2), "quantity": F.lit(1.0), "is_buy": F.lit(True), "bids": none})
    started, path = time.time(), scratch_path(spark, "book-sink")
    J.book_sink(path, 30, layout="plain")(book.unionByName(tape), 0)
    got = spark.read.parquet(f"{path}/rows").agg(F.count(F.lit(1)), F.max("volume_delta")).first()
    assert tuple(got) == (20000, 19999.0) and time.time() - started < 60


def test_a_window_reads_its_rows_once(spark):
    """Rows and what leaves the window come from one reading, on either layout."""
    n = F.col("id")
    made = spark.range(1000).select(F.lit("S").alias("symbol"), (n * 10).alias("_t"), F.lit(1).alias("_slot"), n.alias("_seq"), F.when(n % 3 > 0, n).cast("decimal(18,8)").alias("v"), F.struct("id").alias("_row"))
    plain = B.sliding_sums(made, 50, {"v": "total"}, n_known := F.col("_row").isNotNull(), "plain")
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    got = {r["_row"]["id"]: int(r["total"] or 0) for r in plain.collect()}
    assert got == {i: sum(j for j in range(max(0, i - 5), i + 1) if j % 3) for i in range(1000)}
    assert rows(B.sliding_sums(made, 50, {"v": "total"}, n_known, "blocks").select("_row.id", "total")) == rows(plain.select("_row.id", "total"))
