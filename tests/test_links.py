"""Links over frames by groups and frame by frame, against the plain linking of a whole movie."""

import numpy as np
import pytest

from lumispark.kernels import linking
from lumispark.operators import links, rounds

SCHEMA = "movie_id string, frame int, x double, y double, k long, particle string"


def movie(name, seed, many, size, frames=4, first=0):
    rng = np.random.default_rng(seed)
    return [(name, int(f), float(x), float(y), first + k, "old") for k, (f, x, y) in enumerate(zip(rng.integers(0, frames, many), *rng.random((2, many)) * size))]


def sets(pairs):
    out = {}
    for point, particle in pairs:
        out.setdefault(particle, set()).add(point)
    return sorted(map(sorted, out.values()))


def plain(rows, reach, memory):
    out = []
    for name in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[3], r[2]))
        numbers = linking.link(np.array([r[1] for r in part]), np.array([r[2:4] for r in part]), reach, memory)
        out += [(r[4], (name, n)) for r, n in zip(part, numbers.tolist())]
    return sets(out)


@pytest.mark.parametrize("fit", [0, 7, 50_000])
def test_dense_and_sparse_movies_link_the_same_however_they_are_cut(spark, fit):
    rows = movie("dense", 1, 70, 60) + movie("sparse", 2, 50, 400, first=1000)
    got = links.linked(spark.createDataFrame(rows, SCHEMA).repartition(3), reach=20, memory=1, point="k", fit=fit).collect()
    assert len(got) == len(rows) and sets((r.k, r.particle) for r in got) == plain(rows, 20, 1)
    assert all(r.particle == min((s.frame, s.k) for s in got if s.particle == r.particle)[1] for r in got)  # its first point


def test_nothing_repeated_rows_and_rows_without_a_place(spark):
    assert links.linked(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(None, 0, 1.0, 1.0, 1, ""), (None, 1, 1.0, 1.0, 2, ""), ("m", None, 1.0, 1.0, 3, ""), ("m", 1, None, 1.0, 4, ""), ("m", 2, float("nan"), 1.0, 5, ""), ("m", 3, 1.0, 1.0, 6, "")]
    same = [("n", f, 5.0, 5.0, 10 * f + k, "") for f in range(3) for k in range(2)]
    for fit in (0, 50_000):
        got = links.linked(spark.createDataFrame(odd + same, SCHEMA), fit=fit).collect()
        assert len(got) == 12 and len({r.particle for r in got if r.movie_id != "n"}) == 6
        twins = sets((r.k, r.particle) for r in got if r.movie_id == "n")
        assert [len(t) for t in twins] == [3, 3] and all({k // 10 for k in t} == {0, 1, 2} for t in twins)


def test_pairs_meet_across_cells_and_frames(spark):
    rows = [("m", 0, 19.9, 0.0, 1, ""), ("m", 1, 39.9, 0.0, 2, ""), ("m", 2, -0.1, 0.0, 3, ""), ("m", 3, 19.9, 0.0, 4, ""), ("m", 1, 40.0, 0.0, 5, "")]
    got = {(r.early, r.late) for r in links.candidates(spark.createDataFrame(rows, SCHEMA), ["movie_id"], "frame", ["x", "y"], "k", 20.0, 1).collect()}
    assert got == {(1, 2), (1, 3), (2, 4), (3, 4)}  # not 1 to 4, three frames on, nor 5, too far


def no_broadcast(monkeypatch, module, name):
    """Has each table that `module` writes looked at: joins of what grows may not broadcast."""
    write, seen = getattr(module, name), []

    def look(df, tag):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append(tag)
        assert "BroadcastHashJoin" not in plan or tag in ("points", "places"), (tag, plan)
        return write(df, tag)

    monkeypatch.setattr(module, name, look)
    return seen


def test_rounds_and_candidates_broadcast_nothing(spark, monkeypatch):
    seen = no_broadcast(monkeypatch, rounds, "kept")
    path = spark.range(50).selectExpr("id AS a", "id + 1 AS b")
    assert {(r.node, r.root) for r in rounds.connected(path).collect()} == {(k, 0) for k in range(1, 51)} and "jump" in seen
    points = spark.createDataFrame(movie("a", 1, 60, 40), SCHEMA)
    assert "BroadcastHashJoin" not in links.candidates(points, ["movie_id"], "frame", ["x", "y"], "k", 9.0, 1)._jdf.queryExecution().executedPlan().toString()
