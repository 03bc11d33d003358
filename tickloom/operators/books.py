"""Order-book reconstruction, microstructure features and the time grid.

Books are rebuilt in blocks of consecutive updates. The state a block starts from is derived
relationally: the last update of each price level in each earlier block stays in force until the
level changes again or a snapshot re-seeds the book. Blocks then fold independently, so one busy
symbol spreads over the cluster, and what a task holds is one block plus one book.

Snapshots: ``symbol, last_update_id, captured_at_ms, bids, asks``; deltas: ``symbol,
first_update_id, final_update_id, event_time_ms, bids, asks``; trades: ``symbol, trade_id,
timestamp_ms, quantity, is_buy``. Sides are arrays of (price, quantity), best first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.stats import ratio
from tickloom.operators.series import BLOCK_ROWS, POS, RUN, framed, positions, running
from tickloom.session import stable

KEYS = ("symbol",)
BLOCK_LEVELS = 200_000
DEPTH = 10
# Rolling windows of tape and order flow, and the grid step, in seconds.
WINDOW_SECONDS = 30
GRID_SECONDS = 1


# --- shapes -----------------------------------------------------------------------------------
def flatten_levels(events: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per price level with its side and index."""
    bids = events.select(*keep, F.lit(True).alias("is_bid"), F.posexplode("bids").alias("level_index", "_l"))
    asks = events.select(*keep, F.lit(False).alias("is_bid"), F.posexplode("asks").alias("level_index", "_l"))
    return bids.unionByName(asks).select(*keep, "is_bid", "level_index", "_l.price", "_l.quantity")


def _side(is_bid: bool, order: str) -> Column:
    level = F.when(F.col("is_bid") == is_bid, F.struct(F.col(order).alias("o"), "price", "quantity"))
    return F.transform(F.array_sort(F.array_compact(F.collect_list(level))), lambda x: F.struct(x.price.alias("price"), x.quantity.alias("quantity")))


def _once(rows: DataFrame, key: Sequence[str], order: str, clock: str) -> DataFrame:
    """Repeated copies of a level row fall away before anything is collected."""
    return rows.groupBy(*dict.fromkeys([*key, "is_bid", order, "price", "quantity"])).agg(F.min(clock).alias(clock))


def regroup_deltas(rows: DataFrame, order: str = "level_index") -> DataFrame:
    """Long delta rows back to one row per update (an update's levels are one exchange message)."""
    key = ["symbol", "first_update_id", "final_update_id"]
    return _once(rows, key, order, "event_time_ms").groupBy(*key).agg(
        F.min("event_time_ms").alias("event_time_ms"), _side(True, order).alias("bids"), _side(False, order).alias("asks")
    )


def rebuild_snapshots(rows: DataFrame) -> DataFrame:
    key = ["symbol", "last_update_id"]
    return _once(rows, key, "level_index", "captured_at_ms").groupBy(*key).agg(
        F.min("captured_at_ms").alias("captured_at_ms"), _side(True, "level_index").alias("bids"), _side(False, "level_index").alias("asks")
    )


def load_events(trades: DataFrame, deltas: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tick-lake rows of any symbols and days to (sequenced book events, trade tape)."""
    tape = trades.select("symbol", F.col("exchange_trade_id").cast("long").alias("trade_id"), "timestamp_ms", "quantity", "is_buy")
    return sequence(merge_events(rebuild_snapshots(snapshots), regroup_deltas(deltas, "price"))), tape


# --- sequencing -------------------------------------------------------------------------------
def merge_events(snapshots: DataFrame, deltas: DataFrame) -> DataFrame:
    """Snapshots and deltas as one table; deltas up to the earliest snapshot of a symbol are dropped."""
    s = snapshots.select("symbol", F.col("last_update_id").alias("uid"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("first_uid"), F.col("captured_at_ms").alias("ms"), "bids", "asks")
    first = snapshots.groupBy("symbol").agg(F.min("last_update_id").alias("_seed"))
    d = deltas.join(first, "symbol", "left").filter(F.col("_seed").isNull() | (F.col("final_update_id") > F.col("_seed")))
    d = d.select("symbol", F.col("final_update_id").alias("uid"), F.lit(1).alias("kind"), F.col("first_update_id").alias("first_uid"), F.col("event_time_ms").alias("ms"), "bids", "asks")
    return s.unionByName(d)


def sequence(events: DataFrame, layout: str = "blocks") -> DataFrame:
    """Order book events by update id and label what happens to each.

    ``status``: snapshot, applied, stale (already covered), gap (ids are missing before it), broken
    (behind a gap, until the next snapshot) or unseeded. ``eff_ms`` is the running maximum of event
    time, ``segment`` the number of snapshots so far. In id order the id a row must follow is simply
    the one before it.
    """
    order = ["uid", "kind", "first_uid"]
    # Both runs below share the blocks, so events are shuffled to them once.
    placed = positions(events, KEYS, order, layout).withColumn(RUN, F.expr(f"({POS} - 1) div {BLOCK_ROWS}"))
    levels = F.size("bids") + F.size("asks")
    counted = running(
        placed, KEYS, [POS],
        {"segment": ("count", F.when(F.col("kind") == 0, 1)), "eff_ms": ("max", F.col("ms")), "_levels": ("sum", levels.cast("long")), "_last": ("previous", F.struct("uid"))},
        layout=layout,
    )
    counted = counted.withColumn("last_uid", F.col("_last.uid")).drop("_last")
    delta = F.col("kind") == 1
    stale = delta & F.coalesce(F.col("uid") <= F.col("last_uid"), F.lit(False))
    gap = delta & ~stale & F.coalesce(F.col("first_uid") > F.col("last_uid") + 1, F.lit(False))
    flagged = counted.withColumns({"_stale": stale, "_gap": gap})
    broken = running(flagged, KEYS, [POS], {"_cut": ("max", F.when(F.col("_gap"), F.col("segment")))}, inclusive=False, layout=layout)
    status = (
        F.when(F.col("kind") == 0, "snapshot")
        .when(F.col("segment") == 0, "unseeded")
        .when(F.coalesce(F.col("_cut") == F.col("segment"), F.lit(False)), "broken")
        .when(F.col("_stale"), "stale")
        .when(F.col("_gap"), "gap")
        .otherwise("applied")
    )
    # Updates, opening states and time lines are all read from this table: it is written once.
    return stable(broken.withColumns({"status": status, "_block": F.expr(f"(_levels - size(bids) - size(asks)) div {BLOCK_LEVELS}")}).drop("_stale", "_gap", "_cut", "_levels", RUN))


def gaps(sequenced: DataFrame) -> DataFrame:
    return sequenced.filter("status = 'gap'").select("symbol", (F.col("last_uid") + 1).alias("expected"), F.col("first_uid").alias("got"), F.col("ms").alias("at_ms"))


def continued(known: DataFrame, snapshots: DataFrame, deltas: DataFrame, layout: str = "blocks") -> DataFrame:
    """``sequence`` of one more batch of book events, behind what ``known`` says of each symbol (schema ``CONTINUITY``).

    A book in order stands in the batch as an event of its own (``carried``), in id order before what may follow it, so
    gaps across batches show as those within one. Updates of a book that is broken stay so until a snapshot. ``segment``
    goes on counting. Snapshots in order whose book was not broken are ``scheduled``. ``known`` with bids and asks opens
    the books with these levels.
    """
    none = F.array().cast(snapshots.schema["bids"].dataType)
    opening = [F.col(side) if side in known.columns else none.alias(side) for side in ("bids", "asks")]
    shape = ("symbol", "uid", "kind", "first_uid", "ms", "bids", "asks", "carried")
    events = (
        snapshots.select("symbol", F.col("last_update_id").alias("uid"), F.lit(0).alias("kind"), F.col("last_update_id").alias("first_uid"), F.col("captured_at_ms").alias("ms"), "bids", "asks", F.lit(False).alias("carried"))
        .unionByName(deltas.select("symbol", F.col("final_update_id").alias("uid"), F.lit(1).alias("kind"), F.col("first_update_id").alias("first_uid"), F.col("event_time_ms").alias("ms"), "bids", "asks", F.lit(False).alias("carried")))
        .unionByName(known.filter("seeded").select("symbol", F.col("last_uid").alias("uid"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("first_uid"), F.col("eff_ms").alias("ms"), *opening, F.lit(True).alias("carried")))
        .select(*shape))
    before = known.select("symbol", F.col("last_uid").alias("_known_uid"), F.col("segment").alias("_known_segment"), F.col("seeded").alias("_seeded"))
    seq = sequence(events, layout).join(before, "symbol", "left")
    counted = F.coalesce(F.col("_known_segment"), F.lit(0)) - F.when(F.col("_seeded"), 1).otherwise(0)
    # Rows before the carried one are covered by it; those of a broken book wait for a snapshot.
    status = (F.when(F.col("_seeded") & (F.col("kind") == 1) & (F.col("uid") <= F.col("_known_uid")), "stale")
              .when(~F.col("_seeded") & (F.col("status") == "unseeded") & (F.col("_known_segment") > 0), "broken").otherwise(F.col("status")))
    seq = seq.withColumns({"status": status, "_own": F.col("segment")})
    cut = seq.filter("status = 'gap'").select("symbol", (F.col("_own") + 1).alias("_own"), F.lit(True).alias("_mended")).distinct()
    goes_on = (F.col("status") == "snapshot") & ~F.col("carried") & F.col("_mended").isNull() & (F.col("_own") > 1)
    return seq.join(cut, ["symbol", "_own"], "left").withColumns({"scheduled": goes_on, "segment": (F.col("segment") + counted).cast("long")}).drop("_own", "_mended", "_known_uid", "_known_segment", "_seeded")


def continuity(known: DataFrame, sequenced: DataFrame) -> DataFrame:
    """Where each symbol's book stands after the events of ``continued``: what the next batch goes on from."""
    follows = F.col("status").isin("snapshot", "applied")
    after = sequenced.groupBy("symbol").agg(
        F.max(F.when(follows, F.col("uid"))).alias("last_uid"), F.max("segment").alias("segment"),
        (~F.max_by("status", POS).isin("gap", "broken", "unseeded")).alias("seeded"), F.max("eff_ms").alias("eff_ms"))
    # A book that only broke in this batch still tells which id it had last.
    kept = after.join(known.select("symbol", F.col("last_uid").alias("_known")), "symbol", "left").withColumn("last_uid", F.coalesce("last_uid", "_known"))
    return kept.select(after.columns).unionByName(known.join(after, "symbol", "left_anti").select(after.columns))


def desyncs(sequenced: DataFrame) -> DataFrame:
    """Rows of the desync log: ids missing, and books read again though nothing was missing."""
    missing = gaps(sequenced).withColumn("kind", F.lit("sequence_gap"))
    again = sequenced.filter("scheduled").select("symbol", F.lit(None).cast("long").alias("expected"), F.lit(None).cast("long").alias("got"), F.col("ms").alias("at_ms"), F.lit("scheduled_resnapshot").alias("kind"))
    return missing.unionByName(again)


# --- book state -------------------------------------------------------------------------------
def _updates(sequenced: DataFrame) -> DataFrame:
    """Levels of applied events; an event without levels keeps one empty row."""
    live = sequenced.filter("status IN ('snapshot', 'applied')")
    tagged = F.concat(
        F.transform("bids", lambda l: F.struct(F.lit(True).alias("b"), l.price.alias("p"), l.quantity.alias("q"))),
        F.transform("asks", lambda l: F.struct(F.lit(False).alias("b"), l.price.alias("p"), l.quantity.alias("q"))),
    )
    rows = live.select("symbol", "_block", POS, "segment", (F.col("kind") == 0).alias("reset"), F.posexplode_outer(tagged).alias("_k", "_l"))
    return rows.select("symbol", "_block", POS, "segment", "reset", "_k", F.col("_l.b").alias("is_bid"), F.col("_l.p").alias("price"), F.col("_l.q").alias("quantity"))


def _opening_levels(updates: DataFrame) -> DataFrame:
    """Levels in force when each block starts."""
    level = ["symbol", "is_bid", "price"]
    last = updates.filter("price IS NOT NULL").groupBy(*level, "_block").agg(F.max_by(F.struct("quantity", "segment"), F.struct(POS, "_k")).alias("_s"))
    # Per level: as many rows as blocks that touch it.
    later = Window.partitionBy(*level).orderBy("_block")
    last = last.select(*level, "_block", "_s.quantity", "_s.segment", F.lead("_block").over(later).alias("_until"))
    ends = updates.groupBy("symbol", "_block").agg(F.max("segment").alias("segment"))
    follow = ends.withColumn("_next", F.lead("_block").over(Window.partitionBy("symbol").orderBy("_block")))
    reach = follow.groupBy("symbol", "segment").agg(F.coalesce(F.max_by("_next", "_block"), F.max("_block")).alias("_beyond"))
    live = last.join(ends, ["symbol", "_block", "segment"], "left_semi").join(reach, ["symbol", "segment"]).filter("quantity > 0")
    until = F.least("_until", "_beyond")
    spread = live.withColumn("_block", F.explode(F.when(until > F.col("_block"), F.sequence(F.col("_block") + 1, until))))
    # One event can fill more than a block, so block numbers have holes; those hold nothing to fold.
    spread = spread.join(ends.select("symbol", "_block"), ["symbol", "_block"], "left_semi")
    return spread.select(
        "symbol", "_block", F.lit(0).cast("long").alias(POS), "segment", F.lit(False).alias("reset"), F.lit(0).alias("_k"), "is_bid", "price", "quantity"
    )


QUOTE_DDL = f"symbol string, {POS} bigint, best_bid double, bid_qty double, best_ask double, ask_qty double, bid_depth double, ask_depth double"


def _fold(pdf: pd.DataFrame, depth: int) -> pd.DataFrame:
    """Best quotes and top-level sizes after each event of one block."""
    pdf = pdf.sort_values([POS, "_k"], kind="stable")
    books: tuple[dict, dict] = ({}, {})
    ladders: tuple[list, list] = ([], [])
    out = []

    def top(side: int) -> tuple[float | None, float | None, float | None]:
        prices = ladders[side]
        if not prices:
            return None, None, None
        best = prices[-1] if side else prices[0]
        near = prices[-depth:] if side else prices[:depth]
        return best / 1e8, books[side][best], sum(books[side][p] for p in near)

    current, cleared = 0, 0
    for pos, reset, bid, price, quantity in zip(pdf[POS], pdf["reset"], pdf["is_bid"], pdf["_p"], pdf["_q"]):
        if pos != current:
            if current:
                out.append((current, *top(1), *top(0)))
            current = pos
        if reset and cleared != pos:
            cleared = pos
            for side in (0, 1):
                books[side].clear()
                ladders[side].clear()
        if price < 0:
            continue
        side, key = int(bool(bid)), int(price)
        known = key in books[side]
        if quantity > 0:
            if not known:
                insort(ladders[side], key)
            books[side][key] = quantity
        elif known:
            del books[side][key]
            del ladders[side][bisect_left(ladders[side], key)]
    if current:
        out.append((current, *top(1), *top(0)))
    frame = pd.DataFrame(out, columns=[POS, "best_bid", "bid_qty", "bid_depth", "best_ask", "ask_qty", "ask_depth"])
    frame["symbol"] = pdf["symbol"].iloc[0]
    return frame[["symbol", POS, "best_bid", "bid_qty", "best_ask", "ask_qty", "bid_depth", "ask_depth"]]


def quotes(sequenced: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Best bid/ask with sizes and the summed size of the best ``depth`` levels, after each applied event."""
    updates = _updates(sequenced)
    rows = updates.unionByName(_opening_levels(updates))
    rows = rows.withColumns({"_p": F.coalesce((F.col("price") * 100_000_000).cast("bigint"), F.lit(-1)), "_q": F.col("quantity").cast("double")}).drop("price", "quantity")
    folded = rows.groupBy("symbol", "_block").applyInPandas(lambda pdf: _fold(pdf, depth), QUOTE_DDL)
    events = sequenced.filter("status IN ('snapshot', 'applied')").select("symbol", POS, "uid", "ms", "eff_ms", "segment", "status")
    return events.join(folded, ["symbol", POS])


def full_book(sequenced: DataFrame) -> DataFrame:
    """Every level in force after the last event of each symbol, as (is_bid, price, quantity) rows."""
    updates = _updates(sequenced)
    final = updates.groupBy("symbol").agg(F.max("segment").alias("segment"))
    last = updates.filter("price IS NOT NULL").join(final, ["symbol", "segment"], "left_semi")
    return last.groupBy("symbol", "is_bid", "price").agg(F.max_by("quantity", F.struct(POS, "_k")).alias("quantity")).filter("quantity > 0")


def mid_price(bids: Column, asks: Column) -> Column:
    """Mid of best-first level arrays; NULL if a side is empty."""
    bid, ask = F.try_element_at(bids, F.lit(1)).price, F.try_element_at(asks, F.lit(1)).price
    return (bid.cast("double") + ask.cast("double")) / 2


# --- features ---------------------------------------------------------------------------------
def quote_features() -> dict[str, Column]:
    b, bq, a, aq = (F.col(c) for c in ("best_bid", "bid_qty", "best_ask", "ask_qty"))
    bd, ad = F.col("bid_depth"), F.col("ask_depth")
    mid = (b + a) / 2
    return {
        "spread_abs": a - b,
        "spread_pct": ratio(a - b, mid),
        "mid_price": mid,
        "microprice": ratio(a * bq + b * aq, bq + aq),
        "bid_ask_imbalance": ratio(bq - aq, bq + aq),
        "book_imbalance": ratio(bd - ad, bd + ad),
    }


def flow_increment(pb: Column, pbq: Column, pa: Column, paq: Column) -> Column:
    """Order-flow increment against the previous best quotes; NULL while a side is unknown."""
    b, bq, a, aq = (F.col(c) for c in ("best_bid", "bid_qty", "best_ask", "ask_qty"))
    zero = F.lit(0.0)
    bid = F.when(b >= pb, bq).otherwise(zero) - F.when(b <= pb, pbq).otherwise(zero)
    ask = F.when(a <= pa, aq).otherwise(zero) - F.when(a >= pa, paq).otherwise(zero)
    known = pb.isNotNull() & pa.isNotNull() & b.isNotNull() & a.isNotNull()
    return F.when(known, bid - ask).cast("decimal(18,8)")


def with_flow(df: DataFrame, order: Sequence[str], layout: str) -> DataFrame:
    """``ofi`` of each row. Rows that carry ``_pos`` stay in its order, holes and all: their book is folded once, not placed again."""
    best = ("best_bid", "bid_qty", "best_ask", "ask_qty")
    rows = stable(df) if layout == "blocks" and POS in df.columns else df
    linked = running(rows, KEYS, order, {"_best": ("previous", F.struct(*best))}, layout=layout)
    return linked.withColumn("ofi", flow_increment(*[F.col(f"_best.{c}") for c in best])).drop("_best")


def sliding_sums(rows: DataFrame, span_ms: int, values: Mapping[str, str], probe: Column, layout: str, extra: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Sums of ``values`` over the last ``span_ms`` (edge included) at each probe row.

    Rows carry ``_t`` (ms), ``_slot`` (order inside a millisecond, from 1) and ``_seq``. Every value
    comes back with the opposite sign one millisecond after it leaves the window, so a window of any
    width costs one running sum. Values are decimals: what is added is taken away exactly.
    """
    names = list(values)
    present = F.coalesce(*[F.col(v) for v in names]).isNotNull()
    carried = [c for c in rows.columns if c not in ("symbol", "_t", "_slot", "_seq", *names)]
    # A row and its leaving are made of one reading of the rows, which may be costly to make.
    leaves = F.col("_leaves")
    twice = rows.withColumn("_probe", F.coalesce(probe, F.lit(False))).withColumn("_leaves", F.explode(F.when(present, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    both = twice.select(
        "symbol", F.when(leaves, F.col("_t") + span_ms + 1).otherwise(F.col("_t")).alias("_t"), F.when(leaves, 0).otherwise(F.col("_slot")).alias("_slot"), "_seq", (~leaves & F.col("_probe")).alias("_probe"),
        *[F.when(leaves, -F.col(v)).otherwise(F.col(v)).cast(rows.schema[v].dataType).alias(v) for v in names], *[F.when(~leaves, F.col(c)).alias(c) for c in carried])
    specs: dict[str, tuple[str, Column]] = {out: ("sum", F.col(v)) for v, out in values.items()}
    specs.update(extra or {})
    return running(both, KEYS, ["_t", "_slot", "_seq"], specs, layout=layout).filter("_probe").drop("_probe", *names)


TAPE = {"_buy": "buy_volume", "_sell": "sell_volume", "_trades": "trade_count"}


def _tape_columns() -> list[Column]:
    q = F.col("quantity").cast("decimal(18,8)")
    zero = F.lit(0).cast("decimal(18,8)")
    return [F.when(F.col("is_buy"), q).otherwise(zero).alias("_buy"), F.when(F.col("is_buy"), zero).otherwise(q).alias("_sell"), F.lit(1).cast("decimal(18,8)").alias("_trades")]


def tape_features(window_seconds: int) -> dict[str, Column]:
    buy, sell = F.col("buy_volume").cast("double"), F.col("sell_volume").cast("double")
    some = F.col("trade_count") > 0
    return {
        "trade_imbalance": F.when(some, ratio(buy - sell, buy + sell)),
        "volume_delta": F.when(some, buy - sell),
        "trade_intensity": F.when(some, F.col("trade_count").cast("double") / window_seconds),
    }


QUOTES = ("best_bid", "bid_qty", "best_ask", "ask_qty", "bid_depth", "ask_depth")


def micro_series(book: DataFrame, trades: DataFrame, window_seconds: int = WINDOW_SECONDS, layout: str = "blocks") -> DataFrame:
    """Ten features after every applied book event.

    Measuring ``book`` would fold it twice, so the layout is not automatic here: blocks hold at any
    size, ``plain`` is for callers who know their symbols are small. Book rows come before trades of the same millisecond, so a row sees earlier trades only.
    """
    return rolled(with_flow(book.select("symbol", POS, "uid", "ms", "eff_ms", *QUOTES), [POS], layout), trades, window_seconds, layout)


def rolled(flow: DataFrame, trades: DataFrame, window_seconds: int = WINDOW_SECONDS, layout: str = "blocks", earlier: DataFrame | None = None) -> DataFrame:
    """``micro_series`` of rows that have their order flow; ``earlier`` holds flow (symbol, eff_ms, ofi) from before them."""
    flow = flow.withColumnRenamed(POS, "_seq")
    none = [F.lit(None).cast("decimal(18,8)").alias(n) for n in TAPE]
    b = flow.select("symbol", F.col("eff_ms").alias("_t"), F.lit(1).alias("_slot"), "_seq", *none, F.col("ofi").alias("_ofi"), F.when(F.col("ofi").isNotNull(), 1).cast("decimal(18,8)").alias("_flows"),
                    F.struct("uid", "ms", *QUOTES).alias("_row"))
    if earlier is not None:
        b = b.unionByName(earlier.select("symbol", F.col("eff_ms").alias("_t"), F.lit(1).alias("_slot"), F.lit(0).cast("long").alias("_seq"), *none, F.col("ofi").alias("_ofi"),
                                         F.lit(1).cast("decimal(18,8)").alias("_flows"), F.lit(None).cast(b.schema["_row"].dataType).alias("_row")))
    t = trades.select("symbol", F.col("timestamp_ms").alias("_t"), F.lit(2).alias("_slot"), F.col("trade_id").cast("long").alias("_seq"), *_tape_columns(),
                      F.lit(None).cast("decimal(18,8)").alias("_ofi"), F.lit(None).cast("decimal(18,8)").alias("_flows"), F.lit(None).cast(b.schema["_row"].dataType).alias("_row"))
    seen = sliding_sums(b.unionByName(t), window_seconds * 1000, {**TAPE, "_ofi": "_flow", "_flows": "_n"}, F.col("_row").isNotNull(), layout)
    out = seen.select("symbol", F.col("_row.uid").alias("uid"), F.col("_row.ms").alias("timestamp_ms"), *[F.col(f"_row.{q}").alias(q) for q in QUOTES], *TAPE.values(), "_flow", "_n")
    return out.withColumns({**quote_features(), **tape_features(window_seconds), "order_flow_imbalance": F.when(F.col("_n") > 0, F.col("_flow").cast("double"))}).drop(
        *QUOTES, *TAPE.values(), "_flow", "_n"
    )


def tape_series(sequenced: DataFrame, trades: DataFrame, window_seconds: int = WINDOW_SECONDS, layout: str = "blocks") -> DataFrame:
    """The three tape features after every applied book event: they need its time only, so no book is folded."""
    none = [F.lit(None).cast("decimal(18,8)").alias(n) for n in TAPE]
    b = sequenced.filter(F.col("status").isin("snapshot", "applied")).select(
        "symbol", F.col("eff_ms").alias("_t"), F.lit(1).alias("_slot"), F.col(POS).alias("_seq"), *none, F.struct("uid", "ms").alias("_row"))
    t = trades.select("symbol", F.col("timestamp_ms").alias("_t"), F.lit(2).alias("_slot"), F.col("trade_id").cast("long").alias("_seq"), *_tape_columns(), F.lit(None).cast(b.schema["_row"].dataType).alias("_row"))
    seen = sliding_sums(b.unionByName(t), window_seconds * 1000, TAPE, F.col("_row").isNotNull(), layout)
    out = seen.select("symbol", F.col("_row.uid").alias("uid"), F.col("_row.ms").alias("timestamp_ms"), *TAPE.values())
    return out.withColumns(tape_features(window_seconds)).drop(*TAPE.values())


def align_up(ms: Column, step_ms: int) -> Column:
    return (F.ceil(ms / F.lit(step_ms)) * step_ms).cast("long")


def feature_grid(
    sequenced: DataFrame, book: DataFrame, trades: DataFrame, step_seconds: float = GRID_SECONDS, window_seconds: int = WINDOW_SECONDS, layout: str = "blocks"
) -> DataFrame:
    """Features at every grid point between the first and last event, last known state carried on.

    Each event emits the grid points up to the next event, plus the one at its own time if it is the
    first event there. So points need no join, and nothing at a point comes from a later event. No
    points before the first snapshot or while the book is broken.
    """
    step = int(step_seconds * 1000)
    state = F.struct(F.lit(True).alias("seeded"), *QUOTES)
    known = book.select("symbol", POS, state.alias("_state"))
    lost = F.struct(F.lit(False).alias("seeded"), *[F.lit(None).cast("double").alias(q) for q in QUOTES])
    b = sequenced.filter("status <> 'unseeded'").select("symbol", POS, "eff_ms", "status").join(known, ["symbol", POS], "left")
    zero = [F.lit(None).cast("decimal(18,8)").alias(n) for n in TAPE]
    b = b.select("symbol", F.col("eff_ms").alias("_t"), F.lit(0).alias("_kind"), F.col(POS).alias("_id"), F.coalesce("_state", F.when(F.col("status").isin("gap", "broken"), lost)).alias("_state"), *zero)
    t = trades.select("symbol", F.col("timestamp_ms").alias("_t"), F.lit(1).alias("_kind"), F.col("trade_id").cast("long").alias("_id"), F.lit(None).cast(b.schema["_state"].dataType).alias("_state"), *_tape_columns())
    events = positions(b.unionByName(t), KEYS, ["_t", "_kind", "_id"], layout, name="_seq")

    def neighbours(d: DataFrame, w) -> DataFrame:
        return d.withColumns({"_before": F.lag("_t").over(w), "_after": F.lead("_t").over(w)})

    linked = framed(events, KEYS, ["_seq"], neighbours, back=1, ahead=1, layout=layout)
    now = F.col("_t")
    first = F.col("_before").isNull() | (F.col("_before") < now)
    own = F.when(first & (now % step == 0), F.array(now))
    start = (F.floor(now / step) * step + step).cast("long")
    stop = (F.ceil(F.col("_after") / step) * step - step).cast("long")
    later = F.when(F.col("_after").isNotNull() & (stop >= start), F.sequence(start, stop, F.lit(step).cast("long")))
    nothing = F.array().cast("array<bigint>")
    points = linked.select("symbol", F.explode(F.concat(F.coalesce(own, nothing), F.coalesce(later, nothing))).alias("_t"), F.lit(2).alias("_slot"), "_seq", F.lit(True).alias("_point"),
                           F.lit(None).cast(b.schema["_state"].dataType).alias("_state"), *zero)
    rows = linked.select("symbol", "_t", F.when(first, 1).otherwise(3).alias("_slot"), "_seq", F.lit(False).alias("_point"), "_state", *TAPE)
    seen = sliding_sums(rows.unionByName(points), window_seconds * 1000, TAPE, F.col("_point"), layout, {"_now": ("last", F.col("_state"))})
    grid = seen.filter("_now.seeded").select("symbol", "_t", *[F.col(f"_now.{q}").alias(q) for q in QUOTES], *TAPE.values())
    flow = with_flow(grid, ["_t"], layout)
    flow = flow.select("symbol", "_t", F.lit(1).alias("_slot"), F.col("_t").alias("_seq"), F.col("ofi").alias("_ofi"), F.when(F.col("ofi").isNotNull(), 1).cast("decimal(18,8)").alias("_flows"),
                       *QUOTES, *TAPE.values())
    out = sliding_sums(flow, window_seconds * 1000, {"_ofi": "_flow", "_flows": "_n"}, F.lit(True), layout)
    return out.withColumn("timestamp_ms", F.col("_t")).withColumns(
        {**quote_features(), **tape_features(window_seconds), "order_flow_imbalance": F.when(F.col("_n") > 0, F.col("_flow").cast("double"))}
    ).drop("_t", "_slot", "_seq", *QUOTES, *TAPE.values(), "_flow", "_n")


def grid_summary(grid: DataFrame) -> DataFrame:
    return grid.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("points"), F.count("mid_price").alias("with_mid"), F.count("trade_intensity").alias("with_tape"), F.avg("spread_pct").alias("average_spread_pct")
    )


def replay_summary(series: DataFrame) -> DataFrame:
    """Average relative spread and the last row's mid of each symbol."""
    return series.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("spread_pct").alias("average_spread_pct"), F.max_by("mid_price", F.struct("timestamp_ms", "uid")).alias("last_mid")
    )
