"""Secret scans against a plain scan, the ledger, and the plan."""

import hashlib
import re
import time

import duckdb

from tickloom.llm import secrets

SF = "/root/testdata/sf0.001"
TEXTS = ["token: token: abcdef99 \U0001f600 Password='hunter22' pass", None, "", "AKIA" + "A1" * 10 + " AKIAshort AKIA" + "Z" * 15, "\U0001f600" + "a" * 24 + "é" + "0f" * 11 + "g" + "0f" * 40,
         "API_KEY = \"x.y=z-abc\"apikey:abcde; secret  =  123456", "token=abcdef" * 3 + "\n-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " ftp://u:p@h", "PASSWD:" + "é" * 9, "x" * 50_000 + "secret='" + "q" * 50_000]


def plain(text):
    rules = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
             ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    out = sorted((m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, p, fine) in enumerate(rules) for m in re.finditer(p, text or "", re.A) if fine(m))
    return (*(sum(o[1] == n for o in out) for n in range(3)), hashlib.sha256(",".join(o[2] for o in out).encode()).hexdigest()), [o[2] for o in out]


def test_scan_against_plain(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall() + [(9000 + i // 2, t) for i, t in enumerate(TEXTS * 3)] + [(None, t) for t in TEXTS]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, blob string, kind int")
    got = secrets.report(docs).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted((str(i), *plain(t)[0]) for i, t in rows)
    by_hash = {plain(t)[0]: set(plain(t)[1]) for _, t in rows}
    assert all(by_hash[tuple(r)[1:5]] <= set(r.spans.split(",")) | {""} for r in got)
    assert any("private_key" in r.spans and "code_host" in r.spans and "url_login" in r.spans for r in got)
    assert secrets.report(docs.limit(0)).count() == 0


def test_long_logins_in_urls(spark):
    texts = [f"see https://oauth2accesstoken:{'x' * 300}@host/a", f"ftp://{'u' * 300}:p@h", f"ftp://{'u' * 101}:{'p:' * 5000}@h x://a:b@c", "http://host:80/" + "y" * 300 + "@h", "http://u:" + "y" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: [f"url_login:{m.start()}:{m.end()}" for m in re.finditer(r"://[^\s/:@]+:[^\s/@]+@", t)] for i, t in enumerate(texts)}
    assert [len(want[i]) for i in range(5)] == [1, 1, 2, 0, 0]
    assert {r.doc_id: [x for x in r.spans.split(",") if x.startswith("url_login")] for r in secrets.report(docs).collect()} == want


A, Z = "eyJ" + "a" * 12, "z" * 12
TOKENS = [f"{A}.{A}.{Z}", f"x {A}.{A}.{Z},{A}.{A}.{Z}\U0001f600{A}.{A}.{Z}", f"{A}.{A}.{A}.{A}.{Z}", f"_{A}.{A}.{Z} {A}.{A}.{Z}", f"=é{A}.{A}.{Z}\n{A}.{A}.short", f"{A}.{A}"]


def test_tokens_where_a_run_of_their_characters_begins(spark):
    docs = spark.createDataFrame(list(enumerate(TOKENS)), "doc_id long, text string")
    want = {i: [f"web_token:{m.start()}:{m.end()}" for m in re.finditer(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", t)] for i, t in enumerate(TOKENS)}
    assert [len(want[i]) for i in range(6)] == [1, 3, 1, 1, 1, 0]
    assert {r.doc_id: [x for x in r.spans.split(",") if x.startswith("web_token")] for r in secrets.report(docs).collect()} == want


def test_a_megabyte_of_token_starts_is_read_in_one_go(spark):
    texts = ["eyJ" * 350_000, "-eyJ" * 260_000, "eyJaaaaaaaaaaaa." * 65_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    begin = time.monotonic()
    found = {r.doc_id: r.spans for r in secrets.report(docs).collect()}
    # A start at each of the places would take many minutes.
    assert time.monotonic() - begin < 60
    assert found[0] == found[1] == "" and found[2].startswith("web_token:0:47,web_token:48:95,")


def test_sql_has_the_rules_of_the_operator(spark):
    """Logins and tokens of any length, vertical tabs and other white space, all kinds of texts above."""
    texts = TEXTS + TOKENS + [f"ftp://{'u' * 300}:{'p' * 400}@h", "x://a\x0bb:c@d x://a:b\x0b@c x://q:\u00a0@h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    got = secrets.report(docs)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({secrets.sql()})").fetchall())


def test_columns_named_like_those_inside(spark):
    docs = spark.createDataFrame([(1, "token=abcdef1", 5, 6, 7)], "doc_id long, text string, blob int, span int, number int")
    assert [(r.doc_id, r.n_assign) for r in secrets.report(docs).collect()] == [(1, 1)]
    found, ledger, paths = secrets.scan(docs)
    r = paths.first()
    assert sorted(paths.columns) == sorted(["doc_id", "path_blob", "path_span", "number", "blob", "span"]) and (r.path_blob, r.path_span, r.number, r.span.kind) == (5, 6, 7, "assign")
    assert [df.count() for df in secrets.scan(docs.limit(0))] == [0, 0, 0]


def test_query_equals_its_sql(spark):
    from tickloom.llm.queries import R

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, R.queries["op6_secret_scans"](spark, SF).collect())) == sorted(con.execute(R.sql["op6_secret_scans"]).fetchall())


def test_ledger_scans_only_unseen_pairs(spark):
    first = spark.createDataFrame([("a", 1, "token=abcdef1"), ("b", 1, "clean")], "path string, version int, text string")
    found, ledger, paths = (df.persist() for df in secrets.scan(first))
    assert found.count() == 1 and ledger.count() == 2 and paths.count() == 2
    second = first.union(spark.createDataFrame([("a", 2, "token=abcdef2"), ("c", 1, "token=abcdef1"), ("d", 1, None)], first.schema))
    assert sorted(r.text for r in secrets.unseen(second, ledger).collect()) == ["", "token=abcdef2"]
    found2, ledger2, paths2 = secrets.scan(second, ledger, found)
    assert found2.count() == 2 and ledger2.count() == 4
    assert sorted((r.path, r.version, r.span.kind if r.span else None) for r in paths2.collect()) == [("a", 1, "assign"), ("a", 2, "assign"), ("b", 1, None), ("c", 1, "assign"), ("d", 1, None)]
    # Another rule version scans everything once more.
    assert secrets.unseen(second, ledger2, secrets.RULE_VERSION + 1).count() == 4


def test_plan_is_native(spark):
    from tickloom.llm.queries import R

    plan = R.queries["op6_secret_scans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
