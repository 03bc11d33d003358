"""Mixing against a plain solver, and the pipeline against plain versions of its stages."""

import numpy as np
import pytest

from tickloom.llm import mixing
from test_dedup import plain_components, plain_lines
from test_packing_topk import check_packed
from test_texts import plain_quality

SF = "/root/testdata/sf0.001"
TEXTS = ["trash scum idiot words", "good fine words of prose", "poor ### $$$ junk"]


def table(spark, rows):
    return spark.createDataFrame([(t, [float(x) for x in p]) for t, p in rows], "__tokens long, __posterior array<double>")


def test_rates_against_a_plain_solver(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    tokens = rng.integers(0, 500, 300)
    target = np.array([0.7, 0.25, 0.05])
    moves, reached = mixing.solve(table(spark, zip(tokens.tolist(), p)), target, steps=300, tolerance=1e-6)
    rates = mixing._rates(p, moves)
    assert (rates >= 0).all() and np.allclose((tokens * rates) @ p / tokens.sum(), reached) and np.abs(reached - target).max() <= 1e-6
    # Plain projected gradient on the same problem, from the same start.
    plain = np.ones(300)
    gram = (p * tokens[:, None]).T @ p
    for _ in range(4000):
        plain = np.maximum(0, plain - p @ ((tokens * plain) @ p - target * tokens.sum()) / np.linalg.eigvalsh(gram)[-1])
    assert np.abs((tokens * plain) @ p / tokens.sum() - target).max() < 1e-4 and np.abs(plain - rates).mean() < 0.2


def test_projection_binds(spark):
    # One domain is to vanish: its documents end at rate 0, not below.
    moves, reached = mixing.solve(table(spark, [(10, (1, 0)), (10, (0, 1))]), np.array([1.0, 0.0]), steps=200)
    assert np.allclose(reached, [1, 0], atol=1e-3) and np.allclose(mixing._rates(np.eye(2), moves), [2, 0], atol=1e-2)


@pytest.mark.parametrize("rare, sharp", [(0.01, 8), (0.003, 8), (0.001, 8), (0.0003, 8), (0.003, 3)])
def test_rare_domain_reaches_its_target(spark, rare, sharp):
    # Near-hard and softer posteriors; the rare domain's share of the tokens is up to a hundred times below its target.
    rng = np.random.default_rng(5)
    n = 20_000
    own = np.where(np.arange(n) < rare * n, 2, rng.integers(0, 2, n))
    odds = np.exp(rng.normal(0, 1, (n, 3)) + sharp * np.eye(3)[own])
    p, tokens, target = odds / odds.sum(axis=1, keepdims=True), rng.integers(10, 1000, n), np.array([0.85, 0.12, 0.03])
    frame = table(spark, zip(tokens.tolist(), p)).repartition(4).persist()
    moves, reached = mixing.solve(frame, target)
    frame.unpersist()
    rates = mixing._rates(p, moves)
    assert (rates >= 0).all() and np.abs(reached - target).max() <= mixing.TOLERANCE
    assert np.allclose((tokens * rates) @ p / tokens.sum(), reached)


def test_target_out_of_reach_is_told(spark):
    # All posteriors are alike: the shares stay in proportion, and the nearest ones are found.
    moves, reached = mixing.solve(table(spark, [(5, (0.75, 0.25))] * 4), np.array([0.5, 0.5]))
    assert np.allclose(reached, np.array([0.75, 0.25]) * 0.8)
    with pytest.raises(RuntimeError):
        mixing.solve(table(spark, [(10, (1, 0)), (10, (0, 1))]), np.array([0.9, 0.1]), steps=0)
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "good"), (2, "poor")], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="no rates reach"):
        assert mixing.report(docs, labels, {"good": 0.9, "poor": 0.1}).count() == 2


def test_solve_without_tokens(spark):
    moves, _ = mixing.solve(table(spark, [(0, (0.5, 0.5))]), np.array([1.0, 0.0]))
    assert len(moves) == 0


def test_report_and_drawn(spark):
    rows = [(i, TEXTS[i % 3] + f" n{i % 7}", 1) for i in range(90)] + [(None, None, 2), (None, "", 3), (4, TEXTS[1], 4), (4, TEXTS[1], 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(i, ["toxic", "good", "poor"][i % 3], "x") for i in range(0, 90, 2)] + [(None, "good", ""), (3, None, ""), (0, "toxic", "again"), (77777, "good", "")],
                                   "doc_id long, domain string, text string")
    got = mixing.report(docs, labels, mixing.TARGETS).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 and 0 <= r.copies - np.floor(r.rate) <= 1 for r in got)
    assert all(r.domain == ["toxic", "good", "poor"][r.doc_id % 3] for r in got if r.doc_id not in (None, 4))
    drawn = mixing.drawn(docs, labels, mixing.TARGETS)
    assert drawn.schema == docs.schema and drawn.count() == sum(r.copies for r in got)
    total = sum(r.n_tokens for r in got)
    assert sum(r.n_tokens * r.rate for r in got) == pytest.approx(total, rel=0.02)
    for empty in (labels.limit(0), labels.filter("doc_id > 70000")):
        plain = mixing.report(docs, empty, mixing.TARGETS).collect()
        assert {(r.rate, r.copies, r.domain) for r in plain} == {(1.0, 1, None)} and sum(r.n_tokens for r in plain) == total
        assert mixing.drawn(docs, empty, mixing.TARGETS).count() == len(rows)
    assert mixing.report(docs.limit(0), labels, mixing.TARGETS).count() == 0
    with pytest.raises(ValueError):
        mixing.report(docs, labels, {"other": 1.0})


def test_whole_table_reaches_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mix, _ = mixing.mixture(docs, mixing.domain_labels(spark.read.parquet(f"{sf}/labels.parquet")), mixing.TARGETS)
    assert mix.reached == pytest.approx(mixing.TARGETS, abs=2e-4)


def test_pipeline_against_plain(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == columns
            out = spark.createDataFrame(out.collect(), out.schema)
            now = sorted((r.doc_id, r.text) for r in out.collect())
        if name == "quality_rules":
            want = [(i, t) for i, t in rows if plain_quality(t)[-1]]
        elif name == "line_dedup":
            want = sorted((i, t) for i, _, _, t in plain_lines(rows))
        elif name == "near_dedup":
            heads = {c for _, _, c in plain_components(rows)}
            want = [(i, t) for i, t in rows if i in heads]
        elif name == "source_mixing":
            copies = {r.doc_id: r.copies for r in mixing.report(docs, mixing.domain_labels(spark.read.parquet(f"{SF}/labels.parquet")), mixing.TARGETS).collect()}
            want = sorted(x for x in rows for _ in range(copies[x[0]]))
        else:
            assert check_packed(out.collect(), rows) > 0
            break
        assert now == want, name
        docs, rows = out, now
