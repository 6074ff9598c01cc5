import numpy as np
import pyspark.sql.functions as F
import pytest

from lumispark.llm import additive_index
from lumispark.llm.additive_index import AdditiveCodes, best_rows, nearest_neighbours, share_of, unit

SCHEMA = "vec_id long, embedding array<float>, rank string, score int"


def brute(rows, every, k=5):
    use = {i: np.array(v, np.float64) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in use.items():
        if q % every == 0:
            score = {i: float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)) for i, y in use.items() if i != q}
            out[q] = sorted(score.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def vectors(n, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    return (centres[rng.integers(0, 20, n)] + 0.5 * rng.normal(size=(n, dims))).astype(np.float32)


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(additive_index, "BLOCK", 700)
    monkeypatch.setattr(additive_index, "QUERY_BLOCK", 20)
    monkeypatch.setattr(additive_index, "LEAST", 100)
    rows = [(i, v.tolist(), "r", 1) for i, v in enumerate(vectors(3000))]
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, rerank=100).collect()
    want = brute(rows, 50)
    assert len(got) == 300
    hits = sum(r.vec_id in dict(want[r.query_id]) for r in got)
    assert hits / 300 > 0.95
    for r in got:
        if r.vec_id in dict(want[r.query_id]):
            assert r.score == pytest.approx(dict(want[r.query_id])[r.vec_id], abs=1e-12)
    assert {(r.query_id, r.rank) for r in got} == {(q, k) for q in want for k in range(1, 6)}


def test_beam_search_is_no_worse_than_greedy_and_norms_are_of_the_decoded():
    x = unit(vectors(1500).astype(np.float64)).astype(np.float32)
    wide = AdditiveCodes.train(x, stages=4, codewords=32, beam=8)
    narrow = AdditiveCodes(wide.codebooks, beam=1)
    errors = []
    for codes_of in (wide, narrow):
        codes, norms = codes_of.encode(x)
        decoded = codes_of.decode(codes)
        assert np.allclose(norms, np.linalg.norm(decoded, axis=1), atol=1e-5)
        assert np.allclose(codes_of.scores(x[:9], codes, norms), (x[:9] @ decoded.T / norms).T, atol=1e-4)
        errors.append(((x - decoded) ** 2).sum(axis=1).mean())
    assert errors[0] < errors[1]


def test_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(additive_index, "BLOCK", 300)
    same = vectors(1)[0].tolist()
    rows = [(i, same if i % 2 == 0 else v.tolist(), None, None) for i, v in enumerate(vectors(1000, seed=3))]
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, rerank=20).collect()
    for q in range(0, 1000, 50):
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for i in range(0, 14, 2) if i != q][:5]


def test_repeated_ids_have_the_smallest_vector_and_ask_if_any_does(spark):
    rows = [(0, [1.0, 0.0], None, None), (1, [5.0, 0.0], None, None), (1, [0.0, 1.0], None, None), (2, [1.0, 1.0], None, None)]
    for order in (rows, rows[::-1]):
        got = nearest_neighbours(spark.createDataFrame(order, SCHEMA), (F.col("vec_id") == 0) | (F.col("embedding")[0] == 5.0)).collect()
        assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 2), (0, 2, 1), (1, 1, 2), (1, 2, 0)]


def test_a_block_gives_its_share():
    rng = np.random.default_rng(2)
    assert share_of(200, 1) == 200
    for blocks in (2, 7, 50, 4000):
        most = max(np.bincount(rng.integers(0, blocks, 200), minlength=blocks).max() for _ in range(200))
        assert most <= share_of(200, blocks) <= 200
    assert best_rows(np.array([1.0, 3.0, 3.0, 2.0, 3.0]), 2).tolist() == [1, 2]


def test_edges(spark):
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [1.0, 0.0], None, None), (1, [2.0, 0.0], None, None), (2, [0.0, 0.0], None, None), (3, None, None, None), (4, [1.0, None], None, None), (5, [float("nan"), 1.0], None, None),
            (6, [float("inf"), 1.0], None, None), (7, [0.0, 3.0], None, None), (None, [1.0, 1.0], None, None), (50, [0.0, 0.0], None, None), (1, [2.0, 0.0], None, None), (8, [1.0], None, None), (9, [], None, None)]
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 2, 7, 0.0)]


def test_recall_on_even_directions(spark, monkeypatch):
    """256 directions without clusters: 24 codewords alone leave the nearest far down the list."""
    monkeypatch.setattr(additive_index, "BLOCK", 3000)
    x = np.random.default_rng(9).normal(size=(6000, 256)).astype(np.float32)
    rows = [(i, v.tolist(), "r", 1) for i, v in enumerate(x)]
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, rerank=30, sample=2000).collect()
    want = brute(rows, 100)
    assert sum(r.vec_id in dict(want[r.query_id]) for r in got) / 300 > 0.95
