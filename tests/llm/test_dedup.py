"""Line de-duplication and SimHash near-duplicates, against plain versions."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import xxhash

from tickloom.llm import linededup, simhash

SF = "/root/testdata/sf0.001"
LAST = 2**63 - 1


def plain_lines(rows):
    """(doc_id, n_lines, n_dropped, kept text) of each row."""
    def key(line):
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 10 else None

    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(LAST if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or min(held[key(x)]) == (LAST if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = [(1, "Hello big world\nshort\nHello big world"), (2, " hello BIG world \nother line here\n"), (3, None), (None, "other line here\nx"), (None, "alone line in null\nalone line in null"),
         (2, "again some text\nhello big world"), (5, ""), (5, "ééééééééé\nÉ" + "x" * 20), (6, "ééééééééé\nÉ" + "x" * 20), (0, "again some text"), (7, " padded line "), (8, "padded line\n\x1chello big world")]


def as_digest(rows):
    return sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in rows), key=str)


def test_lines_against_plain(spark):
    many = LINES + [(100 + i, f"shared by many documents\nown line number {i}\n" + "shared by many documents\n" * (i % 3)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 1, "x", b"y") for i, t in many], "doc_id long, text string, n_lines int, __lost string, key binary")
    want = as_digest(plain_lines(many))
    for limits in ({}, {"shard_lines": 3, "group_lines": 7}):
        assert sorted(map(tuple, linededup.report(docs, **limits).collect()), key=str) == want
    assert linededup.report(docs.limit(0)).count() == 0


def test_lines_of_hot_ids(spark):
    # A third of the rows without an id, a third under one id, copies among both: losses go by id and text, a bounded row each.
    texts = [f"line number {n % 40} of many\nanother long line {n % 7}\nown words of {n % 90}" for n in range(300)]
    rows = [(None if n % 3 == 0 else 5 if n % 3 == 1 else 1000 - n, t) for n, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, __lost string, __Key int").repartition(6)
    want = as_digest(plain_lines(rows))
    assert sorted(map(tuple, linededup.report(docs, shard_lines=20, group_lines=50).collect()), key=str) == want
    lost = linededup.losses(docs, shard_lines=20, group_lines=50).collect()
    assert max(sum(len(part) for part in r.lost) // 16 for r in lost) <= 3
    assert len({(r.key, r.route) for r in lost}) == len(lost) <= len({(i, t) for i, t in rows})
    out = linededup.deduplicated(docs)
    assert out.schema == docs.schema and out.count() == 300
    long_text = "\n".join(f"a long text of many lines {n}" for n in range(30_000))
    two = spark.createDataFrame([(1, "a long text of many lines 29999"), (2, long_text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in linededup.report(two).collect()) == [(1, 1, 0), (2, 30_000, 1)]


def test_lines_of_the_table(spark):
    from tickloom.llm.queries import R

    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert sorted(map(tuple, R.queries["op8_line_dedup"](spark, SF).collect()), key=str) == as_digest(plain_lines(rows))


def test_deduplicated_keeps_columns(spark):
    docs = spark.createDataFrame([(i, t, "a", None if t is None else len(t)) for i, t in LINES], "doc_id long, text string, source string, n_chars int")
    out = linededup.deduplicated(docs)
    assert out.schema == docs.schema
    want = [(i, None if t is None else kept, None if t is None else len(kept)) for (i, t), (_, _, _, kept) in zip(LINES, plain_lines(LINES))]
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str) == sorted(want, key=str)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        h = rng.integers(0, 2**64, (n, 2), dtype=np.uint64)
        h[: n // 2, 0] = 7
        own = linededup.PerfectHash.build(h[:, 0], h[:, 1])
        assert sorted(own.index(h[:, 0], h[:, 1])) == list(range(n))
    other = rng.integers(0, 2**64, (500, 2), dtype=np.uint64)
    at = own.index(other[:, 0], other[:, 1])
    assert ((at >= -1) & (at < n)).all()


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c not in "\t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """(doc_id, fingerprint, component) of each row, over all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    label = {p: p for p in distinct}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    points = np.array(distinct, dtype=np.uint64)
    for i, p in enumerate(points):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1:] ^ p) <= 3):
            label[find(int(points[i + 1 + j]))] = find(int(p))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[find(p)] = min(least.get(find(p), LAST), i)
    return [(i, f"{p:016x}", least.get(find(p))) for (i, _), p in zip(rows, prints)]


def near_rows():
    rng = random.Random(6)
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    base = " ".join(f"word{rng.randrange(400)}" for _ in range(900))
    for n in range(40):
        words = base.split()
        words[rng.randrange(900)] = f"other{n}"
        rows.append((5000 + n, " ".join(words)))
    return rows + [(6000, None), (6001, ""), (None, " \t"), (None, "alone words of a null id"), (None, "alone words of a null id"), (6002, "One Two"), (6002, "one\x0btwo"), (6003, "one  TWO"), (6004, "\x1c one")] + [(7000 + i, base) for i in range(50)]


def test_near_duplicates_against_plain(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    want = plain_components(rows)
    for tile in (2048, 8):
        assert sorted(map(tuple, simhash.near_duplicates(docs, tile=tile).collect()), key=str) == sorted(want, key=str)
    heads = simhash.distinct_documents(docs)
    assert heads.schema == docs.schema
    named = {c for _, _, c in want if c is not None}
    got = [r.doc_id for r in heads.collect()]
    assert sorted(i for i in got if i is not None) == sorted(named) and got.count(None) == len({p for _, p, c in want if c is None})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.distinct_documents(docs.limit(0)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "zz yy xx"), (5, "a b c d"), (5, "q w e"), (5, "q w e"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.distinct_documents(docs).collect()), key=str) == sorted([(2, None), (5, "a b c d"), (5, "q w e"), (None, "zz yy xx")], key=str)


def test_forest_links_what_all_pairs_link(monkeypatch):
    rng = np.random.default_rng(0)
    points = set()
    for b in rng.integers(-2**63, 2**63, size=20).tolist():
        for _ in range(30):
            points.add(b)
            b = (b ^ 1 << int(rng.integers(0, 64))) % 2**64
            b -= b >> 63 << 64
    points = rng.permutation(np.array(sorted(points), dtype=np.int64))
    monkeypatch.setattr(simhash, "ROWS", 16)

    def components(pairs):
        label = {int(p): int(p) for p in points}

        def find(p):
            while label[p] != p:
                p = label[p]
            return p

        for x, y in pairs:
            label[max(find(x), find(y))] = min(find(x), find(y))
        return {p: find(p) for p in label}

    true = components([(int(a), int(b)) for a in points for b in points if ((int(a) ^ int(b)) % 2**64).bit_count() <= 3])
    half = len(points) // 2
    one, two = points[:half], points[half:]
    assert components(simhash.forest(points, None, 3)) == true
    assert components(simhash.forest(one, None, 3) + simhash.forest(two, None, 3) + simhash.forest(one, two, 3)) == true
    assert len(simhash.forest(points, None, 3)) < len(points)


def test_forest_counts_the_top_bit():
    low = -2**63 + 1
    assert simhash.forest(np.array([0, low]), None, 3) == simhash.forest(np.array([0]), np.array([low]), 3) == [(0, low)]
    rng = np.random.default_rng(4)
    for n in range(1, 4):
        one = rng.integers(-2**63, 2**63, size=100)
        two = one.copy()
        for _ in range(n):
            two ^= np.left_shift(np.int64(1), rng.integers(0, 64, size=100))
        linked = {frozenset(p) for p in simhash.forest(one, two, 3)}
        assert all(a == b or frozenset((a, b)) in linked for a, b in zip(one.tolist(), two.tolist()))


#: Two texts whose fingerprints differ in two bits, the top one included.
def across_the_top_bit():
    rng = random.Random(11)
    while True:
        words = [f"w{rng.randrange(500)}" for _ in range(150)]
        one = plain_fingerprint(" ".join(words))
        for at in range(0, 150, 10):
            other = [*words[:at], f"x{at}", *words[at + 1:]]
            differ = one ^ plain_fingerprint(" ".join(other))
            if differ >> 63 and 1 < differ.bit_count() <= 3:
                return " ".join(words), " ".join(other)


def test_texts_across_the_top_bit_are_one_component(spark):
    one, two = across_the_top_bit()
    docs = spark.createDataFrame([(4, one), (2, two), (3, "something else altogether here")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {4: 2, 2: 2, 3: 3}
    assert sorted(r.doc_id for r in simhash.distinct_documents(docs).collect()) == [2, 3]


def test_pipeline_stage_keeps_one_of_texts_across_the_top_bit(spark):
    import corpus_pipeline

    one, two = across_the_top_bit()
    docs = spark.createDataFrame([(4, one, "en", "s", 1), (2, two, "en", "s", 1), (3, "something else altogether here", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (-5, -5), (300, 301), (300, 302), (301, 302)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 150: 100, 301: 300, 302: 300}
