"""Raw exchange messages to typed tables, as bulk jobs.

Input rows are ``stream, payload, received_at``; payloads are JSON. Parsing is permissive: a message
that does not fit its type is left out by ``valid`` and counted by ``parse_report``. Field names are
those of the exchange's public API.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import AT_REST



def number(text: Column) -> Column:
    """Exact number at rest scale; NULL (so quarantined) if it has more than eight decimals or no room."""
    stored = text.try_cast(AT_REST)
    # Digits beyond the eighth decimal, or an exponent that hides some.
    finer = text.rlike(r"\.\d{8}\d*[1-9]") | (text.rlike("[eE]") & ~F.coalesce(text.try_cast("double") == stored.cast("double"), F.lit(False)))
    return F.when(~finer, stored)


def fits_scale(value: Column, scale: int = 8) -> Column:
    """Whether a wide decimal survives storage at ``scale`` decimals unrounded."""
    return value == F.round(value, scale)


def scale_guard(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows stored exactly, rows with more than eight decimals naming the first such column)."""
    named = F.coalesce(*[F.when(~fits_scale(F.col(c)), F.lit(c)) for c in columns])
    checked = df.withColumn("offending_column", named)
    stored = {c: F.col(c).cast(AT_REST) for c in columns}
    return checked.filter("offending_column IS NULL").drop("offending_column").withColumns(stored), checked.filter("offending_column IS NOT NULL")


def valid(df: DataFrame, required: list[str]) -> DataFrame:
    return df.dropna(subset=required)


def parse_report(df: DataFrame, required: list[str]) -> DataFrame:
    bad = F.greatest(*[F.col(c).isNull() for c in required]) if len(required) > 1 else F.col(required[0]).isNull()
    return df.agg(F.count(F.lit(1)).alias("messages"), F.count_if(bad).alias("malformed"))


PRICES = ("open", "high", "low", "close", "volume")


def rest_klines(raw: DataFrame, now: Column) -> DataFrame:
    """Kline arrays (``symbol, timeframe, payload``) to candles; closed once the close time has passed."""
    fields = F.from_json("payload", "array<string>")
    out = raw.withColumn("_f", fields)

    def at(i: int) -> Column:
        return F.try_element_at(F.col("_f"), F.lit(i + 1))

    close_time = F.timestamp_millis(at(6).try_cast("bigint"))
    return out.select(
        "symbol", "timeframe", F.timestamp_millis(at(0).try_cast("bigint")).alias("open_time"), close_time.alias("close_time"),
        *[number(at(i)).alias(name) for i, name in enumerate(PRICES, 1)], (close_time <= now).alias("is_closed"),
    )


def ws_klines(raw: DataFrame) -> DataFrame:
    fields = {
        "open_time": ("$.k.t", "ms"), "close_time": ("$.k.T", "ms"), "timeframe": ("$.k.i", "text"), "open": ("$.k.o", "num"), "high": ("$.k.h", "num"),
        "low": ("$.k.l", "num"), "close": ("$.k.c", "num"), "volume": ("$.k.v", "num"), "is_closed": ("$.k.x", "bool"),
    }
    return _cased(raw, "symbol", fields)


def _settled(df: DataFrame) -> DataFrame:
    """The same rows with columns that are made once: without a generator between, whatever makes a column is copied into
    every filter and column that reads it, and a message is parsed as often."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _cased(raw: DataFrame, symbol: str, fields: dict[str, tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields by JSON path: the messages use names that differ only in case (``t`` and ``T``)."""
    def read(name: str, kind: str) -> Column:
        text = F.col(name)
        if kind == "num":
            return number(text)
        if kind == "ms":
            return F.timestamp_millis(text.try_cast("bigint"))
        if kind == "text":
            return text
        if kind == "levels":
            return levels(text)
        return text.try_cast({"long": "bigint", "bool": "boolean"}[kind])

    texts = raw.select(F.get_json_object("payload", "$.s").alias(symbol), *[F.get_json_object("payload", path).alias(n) for n, (path, _) in fields.items()], *keep)
    return _settled(texts).select(symbol, *[read(n, kind).alias(n) for n, (_, kind) in fields.items()], *keep)


def trades(raw: DataFrame) -> DataFrame:
    """A buyer who was the maker means the taker sold."""
    t = _cased(raw, "symbol", {"exchange_trade_id": ("$.t", "text"), "price": ("$.p", "num"), "quantity": ("$.q", "num"), "timestamp_ms": ("$.T", "long"), "_maker": ("$.m", "bool")})
    return t.withColumn("is_buy", ~F.col("_maker")).drop("_maker")


def levels(text: Column) -> Column:
    """Price levels; NULL if one of them is unreadable, so that the message is quarantined and not cut."""
    pairs = F.from_json(text, "array<array<string>>")
    read = F.transform(pairs, lambda x: F.struct(number(F.try_element_at(x, F.lit(1))).alias("price"), number(F.try_element_at(x, F.lit(2))).alias("quantity")))
    # As the one element of an array, the levels are read once for the test and the result.
    return F.transform(F.array(read), lambda own: F.when(F.forall(own, lambda x: x.price.isNotNull() & x.quantity.isNotNull()), own))[0]


def depth_deltas(raw: DataFrame) -> DataFrame:
    """Depth updates; their time is the time of receipt, their order the update ids."""
    d = _cased(raw, "symbol", {"first_update_id": ("$.U", "long"), "final_update_id": ("$.u", "long"), "bids": ("$.b", "levels"), "asks": ("$.a", "levels")}, ("received_at",))
    return d.select("symbol", "first_update_id", "final_update_id", F.unix_millis("received_at").alias("event_time_ms"), "bids", "asks")


def depth_snapshots(raw: DataFrame) -> DataFrame:
    """REST books (``symbol`` beside the payload)."""
    texts = raw.select("symbol", F.get_json_object("payload", "$.lastUpdateId").alias("last_update_id"), "received_at", *[F.get_json_object("payload", f"$.{side}").alias(side) for side in ("bids", "asks")])
    return _settled(texts).select("symbol", F.col("last_update_id").try_cast("bigint").alias("last_update_id"), F.unix_millis("received_at").alias("captured_at_ms"),
                                  *[levels(F.col(side)).alias(side) for side in ("bids", "asks")])


def book_tickers(raw: DataFrame) -> DataFrame:
    return _cased(raw, "symbol", {"update_id": ("$.u", "long"), "bid_price": ("$.b", "num"), "bid_qty": ("$.B", "num"), "ask_price": ("$.a", "num"), "ask_qty": ("$.A", "num")}, ("received_at",)).withColumn(
        "timestamp_ms", F.unix_millis("received_at")).drop("received_at")


def landed_books(raw: DataFrame) -> DataFrame:
    """REST books that landed beside the streams as ``<symbol>@snapshot``."""
    return depth_snapshots(raw.withColumn("symbol", F.upper(F.substring_index("stream", "@", 1))))


# Stream-name endings and the table each one feeds.
ROUTES = {"book_ticker": "@bookTicker", "trades": "@trade", "klines": "@kline", "book_snapshots": "@snapshot"}


def route_of(stream: Column) -> Column:
    route = F.when(stream.contains("@depth"), "book_deltas")
    for name, ending in ROUTES.items():
        route = route.when(stream.contains(ending) if name == "klines" else stream.endswith(ending), name)
    return route


PARSERS = {
    "trades": (trades, ["symbol", "price", "quantity", "timestamp_ms", "is_buy"]),
    "book_ticker": (book_tickers, ["symbol", "update_id", "bid_price", "ask_price"]),
    "book_deltas": (depth_deltas, ["symbol", "first_update_id", "final_update_id", "bids", "asks"]),
    "book_snapshots": (landed_books, ["symbol", "last_update_id", "captured_at_ms", "bids", "asks"]),
    "klines": (ws_klines, ["symbol", "open_time", *PRICES, "is_closed"]),
}


def route(raw: DataFrame) -> dict[str, DataFrame]:
    """Each kind's parsed table; unknown streams and malformed messages are left out and counted by ``quarantine``."""
    tagged = raw.withColumn("_route", route_of(F.col("stream")))
    return {name: valid(_settled(parse(tagged.filter(F.col("_route") == name))), required) for name, (parse, required) in PARSERS.items()}


def quarantine(raw: DataFrame) -> DataFrame:
    """route, messages, malformed: what ``route`` takes and leaves out, unknown streams included."""
    tagged = raw.withColumn("_route", route_of(F.col("stream")))
    out = tagged.filter("_route IS NULL").agg(F.lit("unknown").alias("route"), F.count(F.lit(1)).alias("messages"), F.count(F.lit(1)).alias("malformed"))
    for name, (parse, required) in PARSERS.items():
        counts = parse_report(parse(tagged.filter(F.col("_route") == name)), required)
        out = out.unionByName(counts.select(F.lit(name).alias("route"), "messages", "malformed"))
    return out


# What an instrument gets when a filter is absent or unreadable.
DEFAULT_FILTERS = {"tick_size": "0.01", "lot_size": "0.0001", "min_quantity": "0.0001", "min_notional": "10"}


def exchange_info(raw: DataFrame) -> DataFrame:
    """Symbol rows (``payload`` with ``symbol`` and ``filters``) to instruments."""
    filters = F.from_json(
        F.get_json_object("payload", "$.filters"), "array<struct<filterType: string, tickSize: string, stepSize: string, minQty: string, minNotional: string>>"
    )
    def last(field: str, *kinds: str) -> Column:
        hits = F.array_compact(F.transform(F.filter(filters, lambda f: f["filterType"].isin(*kinds)), lambda f: f[field].try_cast("decimal(18,8)")))
        return F.try_element_at(hits, F.lit(-1))

    found = {
        "tick_size": last("tickSize", "PRICE_FILTER"), "lot_size": last("stepSize", "LOT_SIZE"), "min_quantity": last("minQty", "LOT_SIZE"),
        "min_notional": last("minNotional", "MIN_NOTIONAL", "NOTIONAL"),
    }
    return raw.select(
        F.get_json_object("payload", "$.symbol").alias("symbol"), *[F.coalesce(c, F.lit(DEFAULT_FILTERS[n]).cast("decimal(18,8)")).alias(n) for n, c in found.items()]
    )
