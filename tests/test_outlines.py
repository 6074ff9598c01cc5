"""Outlines: traced, smoothed and filled again, against plain shapes."""

import numpy as np
import pandas as pd
import pytest

from lumispark.operators import outlines

POINT = "k string, nth int, y double, x double"


def frame(spark, masks):
    return spark.createDataFrame([(name, int(y), int(x)) for name, m in masks.items() for y, x in np.argwhere(m)], "k string, y int, x int")


def pixels(runs, name):
    return {(r.y, x) for r in runs if r.k == name for x in range(r.x0, r.x1 + 1)}


def test_traced_outlines_fill_to_the_object_without_its_holes(spark):
    rng = np.random.default_rng(4)
    y, x = np.indices((24, 24)) - 11.5
    ring = (np.hypot(y, x) < 10) & (np.hypot(y, x) > 4)
    rows = np.arange(24)[None, :] <= rng.integers(0, 23, 24)[:, None]
    dot = np.zeros((24, 24), bool)
    dot[5, 5] = True
    corner = dot.copy()
    corner[6, 6:9] = True  # meets the dot at a corner: the longer walk is kept
    masks = {"ring": ring, "rows": rows, "dot": dot, "corner": corner}
    traced = outlines.outlines(frame(spark, masks).union(frame(spark, {"dot": dot})), ["k"])
    got = outlines.filled(traced, ["k"]).collect()
    assert pixels(got, "ring") == set(map(tuple, np.argwhere(np.hypot(y, x) < 10).tolist()))
    assert pixels(got, "rows") == set(map(tuple, np.argwhere(rows).tolist())) and pixels(got, "dot") == {(5, 5)}
    assert pixels(got, "corner") == {(6, 6), (6, 7), (6, 8)}
    around = [(r.y, r.x) for r in traced.filter("k = 'rows'").orderBy("nth").collect()]
    gaps = np.abs(np.diff(np.array([*around, around[0]]), axis=0)).sum(axis=1)
    assert len(set(around)) == len(around) and gaps.max() <= 1  # neighbours all the way round
    assert outlines.outlines(frame(spark, {}), ["k"]).count() == 0


def test_splines_keep_to_their_residual_and_smooth(spark):
    rng = np.random.default_rng(9)
    a = np.arange(900) / 900 * 2 * np.pi
    shapes = {"circle": np.full(900, 100.0), "star": 100 + 25 * np.cos(5 * a)}
    rows = [(k, n, float(200 + (r + e) * np.sin(t)), float(300 + (r + e) * np.cos(t))) for k, rs in shapes.items() for n, (r, e, t) in enumerate(zip(rs, rng.normal(0, 0.3, 900), a))]
    rows += [("point", n, 5.0, 5.0) for n in range(3)]
    smooth = outlines.smoothed(spark.createDataFrame(rows, POINT).repartition(3), ["k"], s=150.0)
    got = smooth.collect()
    assert {r.k for r in got} == {"circle", "star"} and all(r.residual == pytest.approx(150, rel=0.01) for r in got), {(r.k, r.residual) for r in got}
    fill = outlines.filled(smooth, ["k"]).collect()
    y, x = np.indices((400, 600))
    angle, far = np.arctan2(y - 200, x - 300), np.hypot(y - 200, x - 300)
    for name, want in (("circle", far < 100), ("star", far < 100 + 25 * np.cos(5 * angle))):
        true = set(map(tuple, np.argwhere(want).tolist()))
        assert len(pixels(fill, name) ^ true) < 0.02 * len(true)
    path = np.array([(r.y, r.x) for r in sorted((r for r in got if r.k == "circle"), key=lambda r: r.nth)])
    raw = np.array([r[2:] for r in rows[:900]])
    length = lambda p: np.hypot(*np.diff(np.vstack([p, p[:1]]), axis=0).T).sum()
    assert length(path) == pytest.approx(2 * np.pi * 100, rel=0.02) and length(raw) > 1.1 * length(path)


def test_a_tight_spline_goes_through_and_a_loose_one_shrinks(spark):
    rows = [("square", n, y, x) for n, (y, x) in enumerate([(0.0, float(k)) for k in range(10)] + [(float(k), 10.0) for k in range(10)] + [(10.0, 10.0 - k) for k in range(10)] + [(10.0 - k, 0.0) for k in range(10)])]
    table = spark.createDataFrame(rows, POINT)
    tight = outlines.smoothed(table, ["k"], s=0.5).collect()
    assert len(tight) == 40 and tight[0].residual == pytest.approx(0.5, rel=0.01)
    loose = outlines.smoothed(table, ["k"], s=1e9).collect()
    assert max(abs(r.y - 5) + abs(r.x - 5) for r in loose) < 0.01


def test_q76_equals_a_plain_spline_of_each_outline(spark, tmp_path):
    from lumispark.queries import queries

    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(0, 1, (8, 8)) for i in range(6)}
    spark.createDataFrame([(i, v.ravel().tolist()) for i, v in vectors.items()], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    shape = spark.createDataFrame([(i, y, x) for i, v in vectors.items() for y in range(8) for x in range(int((v[y] > 0).sum()) + 1)], "image_id long, y int, x int")
    paths: dict[int, list] = {}
    for r in outlines.outlines(shape, ["image_id"]).orderBy("image_id", "nth").collect():
        paths.setdefault(r.image_id, []).append((r.y, r.x))

    def basis(u):
        """Values of 16 periodic cubic splines from the cube's truncated powers."""
        t = (u[:, None] * 16 - np.arange(16)[None, :]) % 16  # spline k starts at k and ends at k + 4
        cube = lambda z: np.maximum(z, 0) ** 3
        out = (cube(t) - 4 * cube(t - 1) + 6 * cube(t - 2) - 4 * cube(t - 3) + cube(t - 4)) / 6 * (t < 4)
        return np.roll(out, 3, axis=1)

    want = set()
    for i, path in paths.items():
        p = np.array(path)
        steps = np.hypot(*(np.roll(p, -1, axis=0) - p).T)
        b, mean = basis(np.concatenate([[0], np.cumsum(steps)[:-1]]) / steps.sum()), p.mean(axis=0)
        bend = np.eye(16) * 2 - np.roll(np.eye(16), 1, axis=1) - np.roll(np.eye(16), -1, axis=1)
        fit = lambda log: np.linalg.lstsq(np.vstack([b, 10 ** (log / 2) * bend]), np.vstack([p - mean, np.zeros((16, 2))]), rcond=None)[0]  # noqa: B023, E731
        left = lambda log: ((b @ fit(log) - p + mean) ** 2).sum()  # noqa: B023, E731
        low, high = -9.0, 12.0
        while left(low) < 3 and high - low > 1e-13:
            middle = (low + high) / 2
            low, high = (middle, high) if left(middle) < 3 else (low, middle)
        curve = basis(np.arange(len(p)) / len(p)) @ fit(low) + mean
        for gy in range(-3, 12):
            for gx in range(-3, 13):
                ends = zip(curve, np.roll(curve, -1, axis=0))
                want |= {(i, gy, gx)} if sum((a[0] <= gy) != (c[0] <= gy) and gx < a[1] + (gy - a[0]) * (c[1] - a[1]) / (c[0] - a[0]) for a, c in ends) % 2 else set()
    got = {(r.image_id, r.y, x) for r in queries()["q76_smoothed_outlines"](spark, str(tmp_path)).collect() for x in range(r.x0, r.x1 + 1)}
    assert got == want and {i for i, *_ in got} == set(vectors)


def test_objects_are_streamed_whole_in_few_calls(spark):
    calls, rows = spark.sparkContext.accumulator(0), [(None if k == 3 else k, n) for k in range(40) for n in range(1 + k % 7)] + [(99, n) for n in range(500)]

    def run(part, begins):
        calls.add(1)
        ends = [*begins[1:].tolist(), len(part)]
        return pd.DataFrame({"key": part["key"].to_numpy()[begins], "many": np.array(ends) - begins, "right": [part["n"].iloc[a:b].tolist() == list(range(b - a)) for a, b in zip(begins.tolist(), ends)]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 60)
        made = spark.createDataFrame(rows, "key long, n long").repartition(1)
        got = outlines._streamed(made, ["key"], ["n"], run, "key double, many long, right boolean").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((-1 if r.key is None else int(r.key), r.many) for r in got) == sorted([(-1 if k == 3 else k, 1 + k % 7) for k in range(40)] + [(99, 500)])
    assert all(r.right for r in got) and calls.value < 41
