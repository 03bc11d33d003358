"""Explicit table schemas. Money and sizes are decimals, statistics are doubles."""

from __future__ import annotations

from pyspark.sql import types as T

AT_REST = T.DecimalType(38, 8)
MONEY = T.DecimalType(18, 8)


def table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _I, _D, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)

LEVELS = T.ArrayType(table(("price", AT_REST), ("quantity", AT_REST)))

CANDLES = table(
    ("open_time", _L), ("close_time", _L), ("open", AT_REST), ("high", AT_REST), ("low", AT_REST),
    ("close", AT_REST), ("volume", AT_REST), ("symbol", _S), ("timeframe", _S),
)
TRADES = table(
    ("exchange_trade_id", _S), ("price", AT_REST), ("quantity", AT_REST), ("is_buy", _B), ("timestamp_ms", _L),
    ("symbol", _S), ("date", T.DateType()),
)
BOOK_TICKER = table(
    ("update_id", _L), ("bid_price", AT_REST), ("bid_qty", AT_REST), ("ask_price", AT_REST), ("ask_qty", AT_REST),
    ("timestamp_ms", _L), ("symbol", _S), ("date", T.DateType()),
)
BOOK_DELTAS = table(
    ("first_update_id", _L), ("final_update_id", _L), ("is_bid", _B), ("price", AT_REST), ("quantity", AT_REST),
    ("event_time_ms", _L), ("symbol", _S), ("date", T.DateType()),
)
BOOK_SNAPSHOTS = table(
    ("last_update_id", _L), ("is_bid", _B), ("level_index", _I), ("price", AT_REST), ("quantity", AT_REST),
    ("captured_at_ms", _L), ("symbol", _S), ("date", T.DateType()),
)
TICK_KINDS = {
    "trades": TRADES,
    "book_ticker": BOOK_TICKER,
    "book_deltas": BOOK_DELTAS,
    "book_snapshots": BOOK_SNAPSHOTS,
}
GRID_FEATURES = (
    "spread_abs", "spread_pct", "mid_price", "microprice", "bid_ask_imbalance", "book_imbalance",
    "trade_imbalance", "volume_delta", "trade_intensity", "order_flow_imbalance",
)
FEATURE_GRID = table(
    ("timestamp_ms", _L), *[(name, _D) for name in GRID_FEATURES], ("symbol", _S), ("date", T.DateType()),
)
RAW_MESSAGES = table(("stream", _S), ("payload", _S), ("received_at", _TS))
#: In the lake: what the desync log says, and where each symbol's book stands after the newest batch.
DESYNC_ROWS = table(("kind", _S), ("expected", _L), ("got", _L), ("at_ms", _L), ("symbol", _S), ("date", T.DateType()))
CONTINUITY = table(("last_uid", _L), ("segment", _L), ("seeded", _B), ("eff_ms", _L), ("symbol", _S), ("date", T.DateType()))
PUBLISHED_BARS = table(
    ("timeframe", _S), ("open_ms", _L), ("first_us", _L), ("first_id", _L), ("open", AT_REST), ("high", AT_REST), ("low", AT_REST), ("last_us", _L), ("last_id", _L), ("close", AT_REST),
    ("volume", AT_REST), ("trades", _L), ("since", _L), ("revision", _L), ("symbol", _S), ("date", T.DateType()),
)
DESYNC_LOG = table(("symbol", _S), ("kind", _S), ("expected", _L), ("got", _L), ("at_ms", _L))
SIGNALS = table(
    ("strategy_id", _S), ("instrument", _S), ("ts", _TS), ("direction", _S), ("confidence", _D), ("metadata", _S),
)

# Timeframe labels and their length in seconds.
TIMEFRAME_SECONDS = {
    "1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800,
}


def timeframe_seconds(label: str) -> int:
    """Accepts ``1m`` and ``m1`` in any case."""
    text = label.strip().lower()
    if text in TIMEFRAME_SECONDS:
        return TIMEFRAME_SECONDS[text]
    flipped = text[1:] + text[:1]
    if flipped in TIMEFRAME_SECONDS:
        return TIMEFRAME_SECONDS[flipped]
    raise ValueError(f"unknown timeframe {label!r}")
