"""The tick lake's commit log: what readers see after crashes, appends meanwhile and replays; the ingest that uses it."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.session import scratch_path
from tickloom.sources import commits as C
from tickloom.sources import lake as K
from tickloom.sources import messages as M
from tickloom.streaming import jobs as J

DAY = "1970-01-01"


def trades(spark, *ids, symbol="A"):
    rows = [(symbol, str(i), Decimal(1), Decimal(1), True, 1000 + i) for i in ids]
    return spark.createDataFrame(rows, "symbol string, exchange_trade_id string, price decimal(38,8), quantity decimal(38,8), is_buy boolean, timestamp_ms long")


def there(spark, path, **options):
    return sorted(int(r.exchange_trade_id) for r in K.read_ticks(spark, path, "trades", **options).collect())


@pytest.fixture
def lake(spark):
    """Four commits of a day, the last one a batch of a stream."""
    path = scratch_path(spark, "ticks")
    for i in range(3):
        K.append_ticks("trades", trades(spark, i), path)
    K.append_ticks("trades", trades(spark, 3), path, "s-7")
    return path


def compacted(spark, path):
    return {r.kind: (r.files_before, r.files_after, r.rows, r.rewritten) for r in K.compact_day(spark, path, "A", DAY).collect()}["trades"]


def test_compaction_and_the_state_before_it(spark, lake):
    before = C.versions(spark, lake)[-1]
    assert compacted(spark, lake) == (4, 1, 4, True)
    assert compacted(spark, lake) == (1, 1, 4, False)
    assert there(spark, lake) == there(spark, lake, version=before) == [0, 1, 2, 3] and there(spark, lake, version=2) == [0, 1]
    assert there(spark, lake, symbol="A", date=DAY) == [0, 1, 2, 3] and there(spark, lake, symbol="B") == there(spark, lake, date="1970-01-02") == []


def test_a_replayed_batch_adds_nothing_even_after_compaction(spark, lake):
    assert K.append_ticks("trades", trades(spark, 3), lake, "s-7") is None
    compacted(spark, lake)
    assert K.append_ticks("trades", trades(spark, 3), lake, "s-7") is None
    assert there(spark, lake) == [0, 1, 2, 3]
    assert K.append_ticks("trades", trades(spark, 4), lake, "s-8") is not None and K.append_ticks("trades", trades(spark, 5), lake, "other-0") is not None
    assert there(spark, lake) == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("step", ["_write_batch", "commit"])
def test_a_crash_between_any_two_steps_leaves_the_day(spark, lake, monkeypatch, step):
    where, name = (K, step) if step == "_write_batch" else (C, step)
    done = getattr(where, name)

    def lost(*args, **kwargs):
        if step == "_write_batch":
            done(*args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(where, name, lost)
    with pytest.raises(RuntimeError):
        K.compact_day(spark, lake, "A", DAY)
    with pytest.raises(RuntimeError):
        K.append_ticks("trades", trades(spark, 9), lake, "s-8")
    monkeypatch.undo()
    assert there(spark, lake) == [0, 1, 2, 3]
    assert K.append_ticks("trades", trades(spark, 9), lake, "s-8") is not None
    assert compacted(spark, lake) == (5, 1, 5, True) and there(spark, lake) == [0, 1, 2, 3, 9]


def test_a_crash_after_the_commit_is_a_replay(spark, lake, monkeypatch):
    done = C.commit

    def lost(*args, **kwargs):
        done(*args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(C, "commit", lost)
    with pytest.raises(RuntimeError):
        K.append_ticks("trades", trades(spark, 9), lake, "s-8")
    monkeypatch.undo()
    assert K.append_ticks("trades", trades(spark, 9), lake, "s-8") is None
    assert there(spark, lake) == [0, 1, 2, 3, 9]


def test_an_append_during_compaction_stays(spark, lake, monkeypatch):
    done = C.commit

    def meanwhile(session, path, adds, removes=(), *rest):
        if removes:
            done(session, path, K._write_batch(K.tick_rows("trades", trades(spark, 9)), path, "trades", "w-late"))
        return done(session, path, adds, removes, *rest)

    monkeypatch.setattr(C, "commit", meanwhile)
    assert compacted(spark, lake) == (4, 1, 4, True)
    monkeypatch.undo()
    assert there(spark, lake) == [0, 1, 2, 3, 9]


def test_of_two_compactions_one_holds(spark, lake, monkeypatch):
    done = C.commit

    def second(session, path, adds, removes=(), *rest):
        monkeypatch.undo()
        assert compacted(spark, lake) == (4, 1, 4, True)
        return done(session, path, adds, removes, *rest)

    monkeypatch.setattr(C, "commit", second)
    assert compacted(spark, lake) == (4, 4, 4, False)
    assert there(spark, lake) == [0, 1, 2, 3]


def test_two_writers_of_one_version(spark, lake, monkeypatch):
    """The number a writer chose is taken before its file is in place: it goes behind, nothing is written over."""
    done = C._put

    def taken(session, target, lines):
        monkeypatch.undo()
        K.append_ticks("trades", trades(spark, 8), lake)
        return done(session, target, lines)

    monkeypatch.setattr(C, "_put", taken)
    K.append_ticks("trades", trades(spark, 9), lake)
    assert there(spark, lake) == [0, 1, 2, 3, 8, 9] and C.versions(spark, lake) == [1, 2, 3, 4, 5, 6]


def test_states_stand_for_the_commits_before_them(spark, lake, monkeypatch):
    monkeypatch.setattr(C, "CHECKPOINT_EVERY", 3)
    compacted(spark, lake)
    K.append_ticks("trades", trades(spark, 4), lake)
    K.append_ticks("trades", trades(spark, 5), lake)
    names = C._names(spark, f"{lake}/_log")
    assert f"{6:020d}.state" in names and len(C.entries(spark, lake).inputFiles()) < 7
    assert there(spark, lake) == [0, 1, 2, 3, 4, 5] and C.applied(spark, lake, "s") == 7
    assert there(spark, lake, version=4) == [0, 1, 2, 3]


def test_vacuum_takes_what_no_commit_names(spark, lake, monkeypatch):
    compacted(spark, lake)
    K._write_batch(K.tick_rows("trades", trades(spark, 99)), lake, "trades", "w-orphan")
    assert C.vacuum(spark, lake) == 0
    monkeypatch.setattr(C.time, "time", lambda: datetime.now().timestamp() + 2 * 24 * 3600)
    assert C.vacuum(spark, lake) == 5 and C.vacuum(spark, lake) == 0
    monkeypatch.undo()
    assert there(spark, lake) == [0, 1, 2, 3]


def test_symbols_with_odd_names(spark):
    path = scratch_path(spark, "ticks")
    for symbol in ("A/B:C%", "d é=1"):
        K.append_ticks("trades", trades(spark, 1, 2, symbol=symbol), path)
        K.append_ticks("trades", trades(spark, 3, symbol=symbol), path)
    assert {r.symbol for r in K.read_ticks(spark, path, "trades").collect()} == {"A/B:C%", "d é=1"}
    assert [r.files_after for r in K.compact_day(spark, path, "A/B:C%", DAY).collect() if r.kind == "trades"] == [1]
    assert there(spark, path, symbol="A/B:C%") == there(spark, path, symbol="d é=1") == [1, 2, 3]


# --- ingest ---------------------------------------------------------------------------------------
AT = datetime(2024, 1, 1)


def message(stream, body, second):
    return (stream, body, AT + timedelta(seconds=second))


def delta(first, last, price=1, symbol="A"):
    return message(f"{symbol.lower()}@depth@100ms", f'{{"s":"{symbol}","U":{first},"u":{last},"b":[["{price}","2"]],"a":[]}}', last)


def book(uid, symbol="A"):
    return message(f"{symbol.lower()}@snapshot", f'{{"lastUpdateId":{uid},"bids":[["1","1"],["0.5","1"]],"asks":[["2","1"]]}}', uid)


FEED = [
    [delta(1, 2), book(10), delta(8, 9), delta(11, 12), delta(13, 13)],
    [delta(14, 15), delta(12, 13), delta(14, 15)],
    [delta(17, 18), delta(19, 20), book(5, "B")],
    [delta(21, 22), delta(9, 9, symbol="B")],
    [book(30), delta(31, 31), book(32), delta(33, 34), message("a@trade", '{"s":"A","t":1,"T":9000,"p":"1.5","q":"1","m":true}', 40)],
    [delta(35, 35), delta(10, 10, symbol="B"), book(11, "B"), delta(12, 12, symbol="B")],
]
LOGGED = {("A", "sequence_gap", 16, 17), ("A", "scheduled_resnapshot", None, None), ("B", "sequence_gap", 6, 9)}


def ingested(spark, parts, sink=None):
    """The lake after the parts came in, a batch or more each."""
    source, path, progress = (scratch_path(spark, n) for n in ("landed", "lake", "progress"))
    for part in parts:
        spark.createDataFrame(part, schemas.RAW_MESSAGES).repartition(3).write.mode("append").parquet(source)
        J.start(J.raw_stream(spark, source), (sink or J.tick_sink)(path), progress).awaitTermination()
    return path


def log_of(spark, path):
    return {(r.symbol, r.kind, r.expected, r.got) for r in K.read_ticks(spark, path, "desync").collect()}


@pytest.mark.parametrize("parts, layout", [([FEED[0] + FEED[1], FEED[2] + FEED[3], FEED[4] + FEED[5]], "plain"), ([sum(FEED, [])], "blocks")])
def test_continuity_is_the_same_however_the_feed_is_cut(spark, parts, layout):
    path = ingested(spark, parts, lambda p: J.tick_sink(p, layout=layout))
    assert log_of(spark, path) == LOGGED
    assert {r.symbol: (r.last_uid, r.segment, r.seeded) for r in K.read_ticks(spark, path, "continuity").collect()} == {"A": (35, 3, True), "B": (12, 2, True)}
    counts = {k: K.read_ticks(spark, path, k).count() for k in schemas.TICK_KINDS}
    assert counts == {"trades": 1, "book_ticker": 0, "book_deltas": 16, "book_snapshots": 15}


def test_a_broken_book_waits_for_its_snapshot_across_batches(spark):
    path = ingested(spark, [FEED[0] + FEED[1], FEED[2], FEED[3]], lambda p: J.tick_sink(p, layout="plain"))
    state = {r.symbol: (r.last_uid, r.segment, r.seeded) for r in K.read_ticks(spark, path, "continuity").collect()}
    assert state == {"A": (15, 1, False), "B": (5, 1, False)}


def test_a_batch_lost_before_or_after_its_commit_comes_once(spark, monkeypatch):
    path = scratch_path(spark, "lake")
    batches = [spark.createDataFrame(part, schemas.RAW_MESSAGES) for part in (FEED[0] + FEED[1] + FEED[2], FEED[3] + FEED[4] + FEED[5])]
    done = C.commit
    for number, batch in enumerate(batches):
        for after in (False, True):
            def lost(*args, after=after, **kwargs):
                if after:
                    done(*args, **kwargs)
                raise RuntimeError("lost")

            monkeypatch.setattr(C, "commit", lost)
            with pytest.raises(RuntimeError):
                J.tick_sink(path, layout="plain")(batch, number)
            monkeypatch.undo()
        J.tick_sink(path, layout="plain")(batch, number)
    assert log_of(spark, path) == LOGGED and K.read_ticks(spark, path, "book_deltas").count() == 16
    assert len(C.versions(spark, path)) == len(batches)


def test_the_sink_parses_a_batch_once(spark, monkeypatch):
    reads, real = spark.sparkContext.accumulator(0), M.route

    def read(uid):
        reads.add(1)
        return uid

    def counted(raw):
        parts = real(raw)
        own = F.udf(read, "bigint").asNondeterministic()
        return {**parts, "book_deltas": parts["book_deltas"].withColumn("final_update_id", own("final_update_id")), "book_snapshots": parts["book_snapshots"].withColumn("last_update_id", own("last_update_id"))}

    monkeypatch.setattr(M, "route", counted)
    path, batch = scratch_path(spark, "lake"), [m for part in FEED for m in part]
    J.tick_sink(path, layout="plain")(spark.createDataFrame(batch, schemas.RAW_MESSAGES), 0)
    assert log_of(spark, path) == LOGGED
    assert reads.value == sum("@depth" in m[0] or "@snapshot" in m[0] for m in batch) == 21
