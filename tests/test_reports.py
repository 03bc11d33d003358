"""Reports on instruments that lack a price or a name."""

from decimal import Decimal

from conftest import rows

from tickloom.operators import joins as N
from tickloom.operators import reports as Q


def test_positions_without_mark_or_symbol_stay(spark):
    ddl = "position_id long, instrument string, side string, quantity decimal(18,4), entry_price decimal(18,8), status string"
    positions = spark.createDataFrame([(1, "a", "buy", Decimal(2), Decimal(10), "open"), (2, "b", "sell", Decimal(1), Decimal(5), "open"), (3, "c", "buy", Decimal(1), Decimal(7), "open"), (4, "a", "buy", Decimal(1), Decimal(1), "closed")], ddl)
    marks = spark.createDataFrame([("a", Decimal(12)), ("b", Decimal(4))], "instrument string, price decimal(18,8)")
    dims = spark.createDataFrame([("a", "AAA"), ("c", "CCC")], "instrument string, symbol string")
    out = {r.position_id: (r.symbol, None if r.mark is None else float(r.mark), None if r.unrealized_pnl is None else float(r.unrealized_pnl)) for r in Q.open_positions(positions, marks, dims).collect()}
    assert out == {1: ("AAA", 12.0, 4.0), 2: ("?", 4.0, 1.0), 3: ("CCC", None, None)}
    assert rows(N.lookup(marks, dims, "instrument").select("symbol", "price")) == [("AAA", Decimal("12.00000000"))]
    assert sorted(r.symbol for r in N.lookup(marks, dims, "instrument", outer=True, missing={"symbol": "?"}).collect()) == ["?", "AAA"]
