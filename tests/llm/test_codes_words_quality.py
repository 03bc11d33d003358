"""Vector codes, spelling variants and the line classifier, against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import codes, linecrf, permuterm
from tickloom.llm.queries import R

SF = "/root/testdata/sf0.001"


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """Codes by every distance in full, in Python's integers."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [n * scale // d for n, d in (float(x).as_integer_ratio() for x in v)], label, v))
    if not kept:
        return []
    width = max(1, -(-max(len(q) for _, q, _, _ in kept) // parts))
    kept = [(i, q + [0] * (width * parts - len(q)), label, v) for i, q, label, v in kept]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, list(r[3]), r[2] is None, r[2] or 0))[:entries]
    books = [[s[1][p * width:(p + 1) * width] for s in seeds] for p in range(parts)]

    def near(q, p):
        x = q[p * width:(p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        sums = defaultdict(lambda: (0, [0] * width))
        for _, q, _, _ in kept:
            for p in range(parts):
                n, s = sums[p, near(q, p)[1]]
                sums[p, near(q, p)[1]] = (n + 1, [a + b for a, b in zip(s, q[p * width:(p + 1) * width])])
        for (p, j), (n, s) in sums.items():
            books[p][j] = [a // n for a in s]
    out, total = [], Counter()
    for i, q, label, _ in kept:
        found = [near(q, p) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
        total[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in out), key=str)


def coded(spark, rows, **options):
    vectors = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string, vector string")
    return sorted(map(tuple, codes.codes(vectors, **options).collect()), key=str)


def test_codes_against_plain(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=32)], int(rng.integers(3))) for i in rng.permutation(150)]
    rows += [(None, rows[0][1], None), (None, None, 1), (7, rows[5][1], None), (7, rows[5][1], None), (500, [1.0, None], 1), (501, [float("nan")] * 32, 1), (502, [float("-inf")] * 32, 1),
             (503, [], 2), (504, [0.25], 2), (505, [0.5] * 40, 1)]
    rows += [(600 + i, [1.0] * 32, 9) for i in range(40)]
    for options in ({}, {"parts": 4, "entries": 8, "rounds": 3, "scale": 100}):
        assert coded(spark, rows, **options) == plain_codes(rows, **options)
    few = [(5, [1.0] * 16, 1), (3, [0.5] * 16, 1), (4, None, 1)]
    assert coded(spark, few) == plain_codes(few)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


@pytest.mark.parametrize("factor", [1e4, 1e6])
def test_codes_of_large_components(spark, factor):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) * factor for x in rng.normal(size=32)], i % 2) for i in range(90)]
    assert coded(spark, rows) == plain_codes(rows)


def test_transform_keeps_distances_and_sequency():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 7, 16):
        x = rng.integers(-99, 99, (50, n))
        y = codes.transform(x)
        assert ((y**2).sum(axis=1) == y.shape[1] * (x**2).sum(axis=1)).all() and (y[:, 0] == x.sum(axis=1)).all()
    changes = [int((r[1:] != r[:-1]).sum()) for r in codes.transform(np.eye(8, dtype=np.int64)).T]
    assert changes == list(range(8))


def test_nearest_takes_the_lower_of_equal_entries():
    parts = np.array([[[1, 1]], [[0, 3]]])
    books = np.array([[[9, 9], [0, 1], [1, 0], [1, 2], [0, 3]]])
    index, error = codes.nearest(parts, books)
    assert index.tolist() == [[1], [4]] and error.tolist() == [[1], [0]]
    again = codes.nearest(parts.astype(object), books.astype(object))
    assert again[0].tolist() == index.tolist() and again[1].tolist() == error.tolist()


def near_words(a, b):
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= 3}
    near = {w: [v for v in n if near_words(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def word_rows():
    rng = random.Random(8)
    words = ["aabbcc", "abbcc", "aabbc", "aabcc", "aaabbcc", "Größe", "größe", "grösse", "größen", "GRÖSSE", "Éclair", "éclair", "eclair", "mississippi", "misissippi", "missisippi", "mississipi",
             "mississippis", "hello", "hallo", "hullo", "hell", "ello", "aaaaa", "aaaaaa", "aaaaaaa", "a×b÷c×", "ab×÷cd", "zzzzz"]
    rows = [(i, " ".join(rng.choices(words, [1 + 40 // (k + 1) for k in range(len(words))], k=40)) + ", " + "don't-stop") for i in range(60)]
    return rows + [(9, "stone " * 40 + "stonz " * 15 + "stozz " * 4), (None, "hello hello HALLO"), (None, None), (3, ""), (3, "hello " * 4000), (3, "hello " * 4000), (4, "x" * 30_000 + " " + "x" * 30_001), (5, "123 !! \n\n")]


def test_variants_against_plain(spark):
    rows = word_rows()
    docs = spark.createDataFrame([(i, t, "x", 1, "z") for i, t in rows], "doc_id long, text string, word string, n int, prefix string").repartition(5)
    got = sorted(map(tuple, permuterm.variants(docs).collect()))
    assert got == plain_variants(rows) and any(r[2] not in (r[0], r[1]) for r in got)
    assert permuterm.variants(docs.limit(0)).count() == 0


def test_variants_in_small_handfuls(spark, monkeypatch):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(permuterm, "HELD", 10)
    assert sorted(map(tuple, permuterm.word_counts(docs, noise=0, min_points=1, min_count=1).collect())) == sorted(
        Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in run) for _, t in rows for run in re.findall("[A-Za-zÀ-ÿ]+", t or "")).items())


def test_rotation_groups_stay_as_small_as_the_alphabet(spark):
    words = spark.createDataFrame([(c + "hello", 3) for c in "abcdefghij"] + [("hello", 9)], "word string, n long")
    sizes = permuterm.rotations(words).groupBy("prefix").count().agg(F.max("count")).first()[0]
    assert sizes == 11
    got = {r.word: (r.n_near, r.best.word) for r in permuterm.neighbours(words).collect()}
    assert got["hello"] == (10, "ahello") and got["ahello"] == (10, "hello")


@pytest.mark.parametrize("name, table", [("op12_spelling_variants", "documents"), ("op13_vector_codes", "embeddings")])
def test_queries_equal_their_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(R.sql[name]).fetchall()
    got = R.queries[name](spark, SF)
    names = [c[0] for c in con.description]
    assert got.columns == names and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_messages_are_the_chances_of_all_labellings(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(25):
        lines = rng.integers(1, 6, 4)
        odds, move = rng.normal(size=lines.sum()) * 3, np.exp(rng.normal(size=(2, 2)))
        monkeypatch.setattr(linecrf, "BLOCK", int(rng.integers(1, 9)))
        good, at = linecrf.messages(odds, lines, move)[2], 0
        for n in lines.tolist():
            total, mass = np.zeros(n), 0.0
            for states in itertools.product((0, 1), repeat=n):
                w = np.exp(sum(odds[at + i] * (s - 0.5) for i, s in enumerate(states))) * np.prod([move[a, b] for a, b in zip(states, states[1:])])
                total, mass = total + w * np.array(states), mass + w
            assert np.allclose(total / mass, good[at:at + n])
            at += n


def test_odds_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    model = linecrf.Model()
    model.tables, model.edges = rng.normal(size=model.tables.shape), rng.normal(size=3)
    lines = np.array([3, 1, 6, 2, 1, 1, 9])
    bins = rng.integers(0, linecrf.BINS, (lines.sum(), linecrf.FEATURES)).astype(np.uint8)
    want, at = [], 0
    seen = [[t[b + np.arange(linecrf.FEATURES) * linecrf.BINS].sum() for b in bins] for t in model.tables]
    for n in lines.tolist():
        for i in range(at, at + n):
            want.append(model.edges[0] + seen[0][i] + (seen[1][i - 1] if i > at else model.edges[1]) + (seen[2][i + 1] if i < at + n - 1 else model.edges[2]))
        at += n
    for block in (1, 2, 5, 100):
        monkeypatch.setattr(linecrf, "BLOCK", block)
        assert np.allclose(model.odds(bins, lines), want)


def test_features_do_not_depend_on_neighbours_in_a_slice():
    texts = ["A b c\nA b c\n\n", "", "\n", "$$$ *** x", "word " * 500, "one two two one", "日本 語 \U0001f600퟿"]
    lines, size, bins = linecrf.line_features(texts)
    apart = [linecrf.line_features([t]) for t in texts]
    assert lines.tolist() == [t.count("\n") + 1 for t in texts] and size.tolist() == [len(row) for t in texts for row in t.split("\n")]
    assert (bins == np.concatenate([b for _, _, b in apart])).all()
    assert bins[:4, 13].tolist() == [0, linecrf.BINS - 1, 0, 0] and bins[5:8, 13].tolist() == [0, 0, 0]


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = R.queries["op11_quality_classifier"](spark, "/root/testdata/sf0.01")
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_quality_of_odd_rows(spark):
    good, bad = "Some plain words stand here in a line.\nAnd so do these, one more time.", "BUY!! NOW!! BUY!! NOW!!\n$$$ ### $$$"
    docs = spark.createDataFrame([(i, good if i % 2 else bad, "x", 0.5) for i in range(40)] + [(None, None, "x", 0.1), (None, good, "y", 0.2), (100, "", "x", 0.3), (101, "\n" * 70_000 + good, "x", 0.4), (1, good, "x", 0.1)],
                                 "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (7, None, 1), (8, 5, 0), (1, 1, 1), (200, 0, 0)], "doc_id long, quality int, predicted int")
    got = linecrf.quality(docs, labels).collect()
    assert len(got) == 45 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 40)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert {r.score for r in linecrf.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert linecrf.quality(docs.limit(0), labels).count() == 0
