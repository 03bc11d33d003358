"""Registered queries of order books, the trade tape and the feature grid.

Events are read as one exchange feed: sign-ups are book snapshots of five levels a side, all other
events change one level, and every event is also a trade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import books as B
from tickloom.operators.series import measured_layout
from tickloom.plans.adapters import load, r6
from tickloom.plans.registry import Registry

R = Registry()
WINDOW = 1800
STEP = 600


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", "event_type", "user_id", F.unix_millis("ts").alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.lit("ALL").alias("symbol"))


def dec(c: Column) -> Column:
    return c.cast("decimal(18,8)")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(sign: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(dec(F.lit(100) + i * (sign * 0.5)).alias("price"), dec(F.col("k") + i).alias("quantity")))

    return feed(spark, sf_dir).filter("event_type = 'signup'").select("symbol", F.col("event_id").alias("last_update_id"), F.col("ms").alias("captured_at_ms"), side(-1).alias("bids"), side(1).alias("asks"))


def deltas(spark: SparkSession, sf_dir: str, *, lossy: bool = False) -> DataFrame:
    """``lossy`` leaves the errors out, so the ids after them have gaps."""
    f = feed(spark, sf_dir).filter("event_type <> 'signup'")
    f = f.filter("event_type <> 'error'") if lossy else f
    size = dec(F.when(F.col("k") >= 10, F.col("k")).otherwise(0))
    distance = (F.col("user_id") % 20 + 1) * 0.5
    empty = F.array().cast("array<struct<price:decimal(18,8),quantity:decimal(18,8)>>")
    bid = F.col("user_id") % 2 == 0
    return f.select(
        "symbol", F.col("event_id").alias("first_update_id"), F.col("event_id").alias("final_update_id"), F.col("ms").alias("event_time_ms"),
        F.when(bid, F.array(F.struct(dec(F.lit(100) - distance).alias("price"), size.alias("quantity")))).otherwise(empty).alias("bids"),
        F.when(~bid, F.array(F.struct(dec(F.lit(100) + distance).alias("price"), size.alias("quantity")))).otherwise(empty).alias("asks"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).select("symbol", F.col("event_id").alias("trade_id"), F.col("ms").alias("timestamp_ms"), dec(F.col("k") + 1).alias("quantity"), F.col("event_type").isin("click", "purchase", "view").alias("is_buy"))


def layout_of(spark: SparkSession, sf_dir: str) -> str:
    """One size check on the raw feed serves every query built on it."""
    return measured_layout(feed(spark, sf_dir), B.KEYS)


def sequenced(spark: SparkSession, sf_dir: str, *, lossy: bool = False) -> DataFrame:
    return B.sequence(B.merge_events(snapshots(spark, sf_dir), deltas(spark, sf_dir, lossy=lossy)), layout_of(spark, sf_dir))


FEED_SQL = """feed AS (
  SELECT event_id AS uid, event_type, user_id, epoch_us(ts) // 1000 AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
   event_type = 'signup' AS snap, event_type IN ('click', 'purchase', 'view') AS is_buy FROM events),
 seed AS (SELECT min(uid) AS seed FROM feed WHERE snap),
 ev AS (
  SELECT *, count(*) FILTER (snap) OVER (ORDER BY uid) AS seg, max(ms) OVER (ORDER BY uid) AS eff FROM feed WHERE uid >= (SELECT seed FROM seed)),
 lv AS (
  SELECT uid, seg, true AS is_bid, 100 - i * 0.5::DOUBLE AS price, (k + i)::DOUBLE AS q FROM ev CROSS JOIN range(1, 6) r(i) WHERE snap
  UNION ALL SELECT uid, seg, false, 100 + i * 0.5::DOUBLE, (k + i)::DOUBLE FROM ev CROSS JOIN range(1, 6) r(i) WHERE snap
  UNION ALL SELECT uid, seg, user_id % 2 = 0, CASE WHEN user_id % 2 = 0 THEN 100 - (user_id % 20 + 1) * 0.5::DOUBLE ELSE 100 + (user_id % 20 + 1) * 0.5::DOUBLE END,
   CASE WHEN k >= 10 THEN k ELSE 0 END::DOUBLE FROM ev WHERE NOT snap)"""
STATE_SQL = f"""{FEED_SQL},
 slots AS (SELECT DISTINCT is_bid, price FROM lv),
 state AS (
  SELECT ev.uid, s.is_bid, s.price, last_value(lv.q IGNORE NULLS) OVER (PARTITION BY ev.seg, s.is_bid, s.price ORDER BY ev.uid) AS q
  FROM ev CROSS JOIN slots s LEFT JOIN lv ON lv.uid = ev.uid AND lv.is_bid = s.is_bid AND lv.price = s.price),
 live AS (SELECT *, row_number() OVER (PARTITION BY uid, is_bid ORDER BY CASE WHEN is_bid THEN -price ELSE price END) AS depth FROM state WHERE q > 0),
 quote AS (
  SELECT ev.uid, any_value(ev.ms) AS ms, any_value(ev.eff) AS eff, max(price) FILTER (is_bid AND depth = 1) AS bb, max(q) FILTER (is_bid AND depth = 1) AS bq,
   max(price) FILTER (NOT is_bid AND depth = 1) AS ba, max(q) FILTER (NOT is_bid AND depth = 1) AS aq,
   sum(q) FILTER (is_bid AND depth <= 10) AS bd, sum(q) FILTER (NOT is_bid AND depth <= 10) AS ad
  FROM ev LEFT JOIN live ON live.uid = ev.uid GROUP BY ev.uid)"""
OFI = "CASE WHEN {p}bb IS NOT NULL AND {p}ba IS NOT NULL AND bb IS NOT NULL AND ba IS NOT NULL THEN CASE WHEN bb >= {p}bb THEN bq ELSE 0 END - CASE WHEN bb <= {p}bb THEN {p}bq ELSE 0 END - (CASE WHEN ba <= {p}ba THEN aq ELSE 0 END - CASE WHEN ba >= {p}ba THEN {p}aq ELSE 0 END) END"


def flow_sql(source: str, order: str) -> str:
    return f"""lagged AS (SELECT *, lag(bb) OVER w AS pbb, lag(bq) OVER w AS pbq, lag(ba) OVER w AS pba, lag(aq) OVER w AS paq FROM {source} WINDOW w AS (ORDER BY {order})),
 flow AS (SELECT *, {OFI.format(p='p')} AS ofi FROM lagged)"""


QUOTED = "(ba - bb) AS spread_abs, (ba - bb) / nullif((bb + ba) / 2, 0) AS spread_pct, (bb + ba) / 2 AS mid_price, (ba * bq + bb * aq) / nullif(bq + aq, 0) AS microprice, (bq - aq) / nullif(bq + aq, 0) AS bid_ask_imbalance, (bd - ad) / nullif(bd + ad, 0) AS book_imbalance"
NAMES = ("spread_abs", "spread_pct", "mid_price", "microprice", "bid_ask_imbalance", "book_imbalance", "trade_imbalance", "volume_delta", "trade_intensity", "order_flow_imbalance")


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.quotes(sequenced(spark, sf_dir))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.flatten_levels(deltas(spark, sf_dir), ["symbol", "first_update_id", "final_update_id", "event_time_ms"])
    return d


R.add("flatten_book", lambda s, d: B.flatten_levels(snapshots(s, d), ["last_update_id"]).select("last_update_id", "is_bid", F.col("level_index").cast("long").alias("level_index"), r6("price"), r6("quantity")),
      f"WITH {FEED_SQL} SELECT uid AS last_update_id, is_bid, CAST(row_number() OVER (PARTITION BY uid, is_bid ORDER BY abs(price - 100)) - 1 AS BIGINT) AS level_index, price, q AS quantity FROM lv JOIN ev USING (uid) WHERE snap")
R.add("regroup_deltas", lambda s, d: B.regroup_deltas(levels(s, d)).select("final_update_id", "event_time_ms", F.size("bids").cast("long").alias("bids"), F.size("asks").cast("long").alias("asks"), r6(F.coalesce(F.try_element_at("bids", F.lit(1)), F.try_element_at("asks", F.lit(1))).price, "price")),
      """SELECT event_id AS final_update_id, epoch_us(ts) // 1000 AS event_time_ms, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS bids, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS asks,
 CASE WHEN user_id % 2 = 0 THEN 100 - (user_id % 20 + 1) * 0.5::DOUBLE ELSE 100 + (user_id % 20 + 1) * 0.5::DOUBLE END AS price FROM events WHERE event_type <> 'signup'""")
R.add("rebuild_snapshot", lambda s, d: B.rebuild_snapshots(B.flatten_levels(snapshots(s, d), ["symbol", "last_update_id", "captured_at_ms"])).select("last_update_id", "captured_at_ms", r6(F.element_at("bids", 1).price, "best_bid"), r6(F.element_at("asks", -1).price, "worst_ask"), F.size("bids").cast("long").alias("depth")),
      "SELECT event_id AS last_update_id, epoch_us(ts) // 1000 AS captured_at_ms, 99.5::DOUBLE AS best_bid, 102.5::DOUBLE AS worst_ask, 5::BIGINT AS depth FROM events WHERE event_type = 'signup'")
R.add("mid_price_l2", lambda s, d: snapshots(s, d).select("last_update_id", r6(B.mid_price(F.col("bids"), F.col("asks")), "mid")).unionByName(deltas(s, d).select(F.col("final_update_id").alias("last_update_id"), r6(B.mid_price(F.col("bids"), F.col("asks")), "mid"))),
      "SELECT event_id AS last_update_id, CASE WHEN event_type = 'signup' THEN 100.0::DOUBLE END AS mid FROM events")
R.add("book_event_merge", lambda s, d: sequenced(s, d).select("uid", F.col("kind").cast("long").alias("kind"), "eff_ms", "segment"),
      f"WITH {FEED_SQL} SELECT uid, CASE WHEN snap THEN 0 ELSE 1 END::BIGINT AS kind, eff AS eff_ms, seg AS segment FROM ev")
R.add("book_seed", lambda s, d: sequenced(s, d).groupBy("segment").agg(F.count_if(F.col("status") == "snapshot").alias("snapshots"), F.count_if(F.col("status") == "applied").alias("applied"), F.min("uid").alias("seeded_by")),
      f"WITH {FEED_SQL} SELECT seg AS segment, 1::BIGINT AS snapshots, count(*) - 1 AS applied, min(uid) AS seeded_by FROM ev GROUP BY seg")
# Every delta sent twice: the second copy is covered already.
R.add("book_stale_drop", lambda s, d: B.sequence(B.merge_events(snapshots(s, d), deltas(s, d).unionByName(deltas(s, d))), layout_of(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
      f"WITH {FEED_SQL}, c AS (SELECT count(*) FILTER (snap) AS s, count(*) FILTER (NOT snap) AS d FROM ev) SELECT 'snapshot' AS status, s AS n FROM c UNION ALL SELECT 'applied', d FROM c UNION ALL SELECT 'stale', d FROM c")
R.add("book_gap_detect", lambda s, d: B.gaps(sequenced(s, d, lossy=True)).select("expected", "got", "at_ms"),
      f"""WITH {FEED_SQL}, kept AS (SELECT *, lag(uid) OVER (ORDER BY uid) AS prev FROM ev WHERE event_type <> 'error'),
 holes AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY uid) AS nth FROM kept WHERE NOT snap AND uid > prev + 1)
 SELECT prev + 1 AS expected, uid AS got, ms AS at_ms FROM holes WHERE nth = 1""")
R.add("book_best", lambda s, d: book(s, d).select("uid", *[r6(c) for c in ("best_bid", "bid_qty", "best_ask", "ask_qty")]),
      f"WITH {STATE_SQL} SELECT uid, bb AS best_bid, bq AS bid_qty, ba AS best_ask, aq AS ask_qty FROM quote")
R.add("book_top_n", lambda s, d: book(s, d).select("uid", r6("bid_depth"), r6("ask_depth")),
      f"WITH {STATE_SQL} SELECT uid, bd AS bid_depth, ad AS ask_depth FROM quote")
R.add("book_apply", lambda s, d: B.full_book(sequenced(s, d)).select("is_bid", r6("price"), r6("quantity")),
      f"""WITH {FEED_SQL}, last AS (SELECT is_bid, price, max_by(q, uid) AS quantity FROM lv WHERE seg = (SELECT max(seg) FROM ev) GROUP BY ALL)
 SELECT is_bid, price, quantity FROM last WHERE quantity > 0""")
R.add("book_project", lambda s, d: B.full_book(sequenced(s, d)).groupBy("is_bid").agg(F.count(F.lit(1)).alias("levels"), r6(F.sum("quantity"), "size"), r6(F.min("price"), "low"), r6(F.max("price"), "high")),
      f"""WITH {FEED_SQL}, last AS (SELECT is_bid, price, max_by(q, uid) AS quantity FROM lv WHERE seg = (SELECT max(seg) FROM ev) GROUP BY ALL)
 SELECT is_bid, count(*) AS levels, sum(quantity) AS size, min(price) AS low, max(price) AS high FROM last WHERE quantity > 0 GROUP BY is_bid""")


def quoted(*names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = B.quote_features()
        return book(spark, sf_dir).select("uid", *[r6(f[n], n) for n in names])

    return query, f"WITH {STATE_SQL}, f AS (SELECT uid, {QUOTED} FROM quote) SELECT uid, {rounded(*names)} FROM f"


for query_name, feature_names in (
    ("micro_spread", ("spread_abs",)), ("micro_spread_pct", ("spread_pct",)), ("micro_mid", ("mid_price",)), ("micro_microprice", ("microprice",)),
    ("micro_l1_imbalance", ("bid_ask_imbalance",)), ("micro_depth_imbalance", ("book_imbalance",)),
):
    R.add(query_name, *quoted(*feature_names))

SERIES_SQL = f"""{STATE_SQL}, {flow_sql('quote', 'uid')},
 tape AS (
  SELECT q.uid, sum(f.k + 1) FILTER (f.is_buy) AS b, sum(f.k + 1) FILTER (NOT f.is_buy) AS s, count(f.uid) AS n
  FROM quote q LEFT JOIN feed f ON f.ms >= q.eff - {WINDOW * 1000} AND f.ms < q.eff GROUP BY q.uid),
 rolled AS (SELECT a.uid, sum(b.ofi) AS ofi FROM flow a JOIN flow b ON b.uid <= a.uid AND b.eff >= a.eff - {WINDOW * 1000} GROUP BY a.uid),
 series AS (
  SELECT q.uid, q.ms AS timestamp_ms, {QUOTED}, CASE WHEN n > 0 THEN (coalesce(b, 0) - coalesce(s, 0)) / (coalesce(b, 0) + coalesce(s, 0)) END AS trade_imbalance,
   CASE WHEN n > 0 THEN CAST(coalesce(b, 0) - coalesce(s, 0) AS DOUBLE) END AS volume_delta, CASE WHEN n > 0 THEN n / {WINDOW}.0::DOUBLE END AS trade_intensity, r.ofi AS order_flow_imbalance
  FROM quote q JOIN tape USING (uid) JOIN rolled r USING (uid))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.micro_series(book(spark, sf_dir), trades(spark, sf_dir), WINDOW, layout_of(spark, sf_dir))


R.add("ofi_increment", lambda s, d: B.with_flow(book(s, d), ["_pos"], layout_of(s, d)).select("uid", r6("ofi")), f"WITH {STATE_SQL}, {flow_sql('quote', 'uid')} SELECT uid, ofi FROM flow")


def tape_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tape_series(sequenced(spark, sf_dir), trades(spark, sf_dir), WINDOW, layout_of(spark, sf_dir))


for query_name, feature_names, source in (
    ("tape_imbalance", ("trade_imbalance",), tape_features), ("tape_volume_delta", ("volume_delta",), tape_features), ("tape_intensity", ("trade_intensity",), tape_features),
    ("ofi_rolling", ("order_flow_imbalance",), series), ("micro_series", NAMES, series),
):
    R.add(query_name, lambda s, d, n=feature_names, f=source: f(s, d).select("uid", "timestamp_ms", *[r6(c) for c in n]), f"WITH {SERIES_SQL} SELECT uid, timestamp_ms, {rounded(*feature_names)} FROM series")
R.add("replay_day_job", lambda s, d: B.replay_summary(series(s, d)).select("rows", r6("average_spread_pct"), r6("last_mid")),
      f"WITH {SERIES_SQL} SELECT count(*) AS rows, round(avg(spread_pct), 6) AS average_spread_pct, round(max_by(mid_price, uid), 6) AS last_mid FROM series")
R.add("grid_align", lambda s, d: feed(s, d).select("event_id", B.align_up(F.col("ms"), 1000).alias("aligned")), "SELECT event_id, CAST(ceil((epoch_us(ts) // 1000) / 1000.0) AS BIGINT) * 1000 AS aligned FROM events")
GRID_SQL = f"""{STATE_SQL},
 steps AS (SELECT g AS t FROM range((SELECT min(ms) // {STEP * 1000} * {STEP * 1000} FROM feed), (SELECT max(ms) + 1 FROM feed), {STEP * 1000}) r(g) WHERE g > (SELECT min(ms) FROM ev)),
 grid AS (SELECT t, (SELECT max(uid) FROM ev WHERE eff < t) AS uid FROM steps),
 held AS (SELECT t, bb, bq, ba, aq, bd, ad FROM grid JOIN quote USING (uid)), {flow_sql('held', 't')},
 rolled AS (SELECT a.t, sum(b.ofi) AS ofi FROM flow a JOIN flow b ON b.t <= a.t AND b.t >= a.t - {WINDOW * 1000} GROUP BY a.t),
 tape AS (SELECT h.t, sum(f.k + 1) FILTER (f.is_buy) AS b, sum(f.k + 1) FILTER (NOT f.is_buy) AS s, count(f.uid) AS n FROM held h LEFT JOIN feed f ON f.ms >= h.t - {WINDOW * 1000} AND f.ms < h.t GROUP BY h.t),
 points AS (
  SELECT t AS timestamp_ms, {QUOTED}, CASE WHEN n > 0 THEN (coalesce(b, 0) - coalesce(s, 0)) / (coalesce(b, 0) + coalesce(s, 0)) END AS trade_imbalance,
   CASE WHEN n > 0 THEN CAST(coalesce(b, 0) - coalesce(s, 0) AS DOUBLE) END AS volume_delta, CASE WHEN n > 0 THEN n / {WINDOW}.0::DOUBLE END AS trade_intensity, ofi AS order_flow_imbalance
  FROM held JOIN tape USING (t) JOIN rolled USING (t))"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = sequenced(spark, sf_dir)
    return B.feature_grid(q, B.quotes(q), trades(spark, sf_dir), STEP, WINDOW, layout_of(spark, sf_dir))


R.add("feature_grid", lambda s, d: grid(s, d).select("timestamp_ms", *[r6(n) for n in NAMES]), f"WITH {GRID_SQL} SELECT timestamp_ms, {rounded(*NAMES)} FROM points")
R.add("grid_day_job", lambda s, d: B.grid_summary(grid(s, d)).select("points", "with_mid", "with_tape", r6("average_spread_pct")),
      f"WITH {GRID_SQL} SELECT count(*) AS points, count(mid_price) AS with_mid, count(trade_intensity) AS with_tape, round(avg(spread_pct), 6) AS average_spread_pct FROM points")
