"""Packing and exact search, against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import packing, tokens, topk

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def check_plan(plan, counts, capacity):
    used = Counter()
    for times, sizes in plan:
        assert times > 0 and sum(sizes) <= capacity
        for s in sizes:
            used[s] += times
    assert used == Counter({s: n for s, n in counts.items() if n})


def fewest_bins(sizes, capacity):
    """Exact, by subsets: (bins, room used in the last one)."""
    best = {0: (1, 0)}
    for mask in range(1, 1 << len(sizes)):
        found = None
        for i, s in enumerate(sizes):
            if mask >> i & 1:
                bins, used = best[mask ^ 1 << i]
                now = (bins, used + s) if used + s <= capacity else (bins + 1, s)
                found = now if found is None or now < found else found
        best[mask] = found
    return best[(1 << len(sizes)) - 1][0] if sizes else 0


def test_bin_completion_is_optimal_on_small_sets():
    rng = random.Random(2)
    for _ in range(120):
        capacity = rng.choice([10, 17, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = Counter(sizes)
        plan = packing.bin_completion(counts, capacity)
        check_plan(plan, counts, capacity)
        check_plan(packing.best_fit(counts, capacity), counts, capacity)
        assert packing.lower_bound(counts, capacity) <= sum(t for t, _ in plan) == fewest_bins(sizes, capacity)


def test_a_filling_may_be_used_less_often_than_it_goes():
    sizes = [4, 4, 13, 4, 13, 3, 3, 4, 6, 12, 4, 6, 12, 11]
    plan = packing.bin_completion(Counter(sizes), 20)
    check_plan(plan, Counter(sizes), 20)
    assert sum(t for t, _ in plan) == 5
    rng = random.Random(11)
    for _ in range(60):
        capacity = rng.choice([12, 20, 25])
        sizes = [rng.choice([3, 4, 6, 7, 11, 12, 13][: 4 + rng.randint(0, 3)]) for _ in range(rng.randint(8, 13))]
        sizes = [min(s, capacity) for s in sizes]
        plan = packing.bin_completion(Counter(sizes), capacity)
        check_plan(plan, Counter(sizes), capacity)
        assert sum(t for t, _ in plan) == fewest_bins(sizes, capacity), (capacity, sizes)


def test_any_stop_leaves_a_whole_packing():
    rng = random.Random(4)
    counts = Counter(rng.randint(300, 900) for _ in range(3000))
    most = sum(t for t, _ in packing.best_fit(counts, 2048))
    for work in (0, 1, 500, 50_000):
        plan = packing.bin_completion(counts, 2048, work=work)
        check_plan(plan, counts, 2048)
        assert packing.lower_bound(counts, 2048) <= sum(t for t, _ in plan) <= most


def test_search_beats_best_fit():
    # Best-fit decreasing needs 3 bins of 10 for these, two are enough.
    counts = {4: 2, 3: 4}
    assert sum(t for t, _ in packing.best_fit({4: 2, 3: 4}, 10)) == 3
    assert sum(t for t, _ in packing.bin_completion(counts, 10)) == 2


def test_many_pieces_reach_the_bound():
    rng = random.Random(9)
    counts = Counter(rng.randint(1, 2047) for _ in range(20_000))
    plan = packing.bin_completion(counts, 2048)
    check_plan(plan, counts, 2048)
    assert sum(t for t, _ in plan) <= packing.lower_bound(counts, 2048) + 1


def test_chunked_ids_are_the_tokenizers():
    exact = Tokenizer.from_file(PATH)
    odd = ["", " ", " a", "a ", "a  b", "a \n b", "x <|endoftext|> y<|endoftext|>", "it's 's  don't ", "a  b c\x1cd e", "日本 語\t x", "y" * 300 + " z", "\n\n a b \n", "é" * 70 + " \U0001f600 q"]
    rows = [t for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    for text in rows[:80] + odd:
        assert tokens.encoded([text], PATH)[0] == np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text
    assert tokens.encoded(odd, PATH) == [tokens.encoded([t], PATH)[0] for t in odd]


def test_words_of_runs_are_the_tokenizers():
    exact = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    bits = ["foo", "Bar", "é", "ß", "ÿ", "×", "÷", "ª", "µ", "7", "42", "²", ",", ".", "...", "%%%", "'", "'s", "'LL", "<", "<|endoftext|>", "_", "-", "\n", "\n\n", "\t", "\u00a0", "漢", "a\u0301", "`", "~", "{}", "@", "&"]
    texts = [" ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    texts += ["it's a dog's.Life don't", "x 1a2b3c 1.5e10,7 a_b-c/d\ne.f\n g \nh", "b " + "y" * 100 + "," + "z" * 100]
    want = [np.array(exact.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert tokens.encoded(texts, PATH) == want
    assert [i for i in tokens.Encoder(PATH).encode(texts[::-1])] == want[::-1]


def check_packed(rows, texts_by_id, capacity=2048):
    """Pieces rebuild every document; sequences are gapless and not too long."""
    exact = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in texts_by_id:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packed_table(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall() + [(None, None), (None, ""), (7, "again and again"), (7, "again and again"), (9001, "long " * 5000)]
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in rows], "doc_id long, text string, length long, sequence_id string")
    for bucket_rows in (50_000, 2):
        got = packing.pack(packing.pieces(docs, PATH), bucket_rows=bucket_rows).collect()
        used = check_packed(got, rows)
        assert used <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).count() == 0


def plain_top(rows, k=20, every=20):
    fine = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            fine.append((i, [int(np.floor(64 * float(x))) for x in v]))
    out = []
    for at, (i, q) in enumerate(fine):
        if i is not None and i % every == 0:
            score = sorted((-sum(a * b for a, b in zip(q, v)), c is None, c or 0, n) for n, (c, v) in enumerate(fine) if n != at)[:k]
            out += [(i, n + 1, None if none else c, -s) for n, (s, none, c, _) in enumerate(score)]
    return sorted(out, key=str)


def test_top_k_against_plain(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 64]) for i in range(150)]
    rows += [(None, [1.0] * 5), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (220, [float("nan")] * 5), (240, [float("inf")] * 5), (260, []), (300, [0.5, -0.25]), (40, rows[40][1]), (40, rows[40][1]), (None, rows[40][1]), (60, [-1.0] * 5), (-20, [0.1] * 5)]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    want = plain_top([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    for blocks in ({}, {"query_block": 3, "candidate_block": 16}):
        assert sorted(map(tuple, topk.top_k(vectors, **blocks).collect()), key=str) == want
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(2)
    for factor in (1e5, 1e6, 3e6):
        rows = [(i, [float(x) * factor for x in rng.normal(size=16)]) for i in range(120)] + [(500 + i, [factor] * 16) for i in range(30)]
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, topk.top_k(vectors, candidate_block=64).collect()), key=str) == plain_top(rows)
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9])], "vec_id long, embedding array<double>")).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_best_takes_earlier_ones_of_equal_scores():
    scores = np.array([[5, 7, 5, 5, 7, 5, 1], [1, 1, 1, 1, 1, 1, 1]])
    query, at = topk.best(scores, np.array([1, -1]), 3)
    assert list(zip(query.tolist(), at.tolist())) == [(0, 0), (0, 2), (0, 4), (1, 0), (1, 1), (1, 2)]


def test_sparse_and_dense_terms_add_up():
    rng = np.random.default_rng(3)
    q, c = rng.integers(-9, 9, (20, 12)), rng.integers(-9, 9, (70, 12))
    c[:, ::2] *= rng.random((70, 6)) < 0.2
    assert (topk.accumulate(q, c) == q @ c.T).all()
    big = topk.accumulate(q * 10**6, c * 10**6)
    assert (big == (q * 10**6) @ (c * 10**6).T).all()


def test_query_equals_its_sql(spark):
    from tickloom.llm.queries import R

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, R.queries["op5_exact_topk"](spark, SF).collect())) == sorted(con.execute(R.sql["op5_exact_topk"]).fetchall())
