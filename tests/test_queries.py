"""The registered queries: importable without a session, consistent, and a sample against DuckDB.

The whole list is compared outside the test run; the sample holds one query of each kind.
"""

import math
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
SAMPLE = ("resample", "validation_report", "feat_bollinger", "feat_rsi", "affine_scan", "strat_mean_reversion", "perf_trades", "eq_monthly", "judge_state_hysteresis", "q_timeline", "asof_join", "sig_deciles",
          "book_best", "feature_grid", "ledger_close", "diag_pairs", "norm_ws_kline", "compact_day", "stream_closed_dedup", "late_repair", "stream_robot_sync")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_listing_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 190 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def tidy(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    return round(float(value), 5) + 0.0 if not isinstance(value, (list, tuple)) else tuple(map(tidy, value))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expect = sorted((tuple(tidy(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=str)
    assert len(got) == len(expect) and all(
        a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5) for x, y in zip(got, expect) for a, b in zip(x, y))


def test_flagship_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_listing_without_the_training_data_operators():
    code = "import sys; sys.modules['tickloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 190 and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
