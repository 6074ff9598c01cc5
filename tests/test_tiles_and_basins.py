"""Tiles with halos, resampling, watershed and selection, against whole-array or brute-force forms."""

import numpy as np
import pyspark.sql.functions as F
import pytest

from lumispark.kernels import filters, morphology, segmentation
from lumispark.operators.selection import percentiles, ranked_values
from lumispark.operators.tables import factorize
from lumispark.operators.tiles import by_tile, resampled
from lumispark.operators.watershed import watershed
from tests.test_runs_and_lines import arrays, frame

KERNELS = {
    "gaussian": (lambda v: filters.gaussian(v, 1.5), 6),
    "laplace": (filters.laplace, 1),
    "rolling_ball": (lambda v: filters.rolling_ball(v, 3), 6),
    "orientation": (lambda v: segmentation.orientation(v, 0.8), 4),
    "closing": (lambda v: morphology.closing((v > 0).astype(float), morphology.ball(2, 2)), 4),
}


@pytest.mark.parametrize("name", sorted(KERNELS))
@pytest.mark.parametrize("tile", [5, 16, 300])
def test_tiles_give_what_whole_images_do(spark, name, tile):
    kernel, reach = KERNELS[name]
    rng = np.random.default_rng(4)
    images = {"a": rng.normal(size=(37, 23)), "b": rng.normal(size=(6, 50)), "c": rng.normal(size=(1, 1)) if name not in ("orientation",) else rng.normal(size=(3, 3))}
    df, axes = frame(spark, images, kind="double")
    got = arrays(by_tile(df, ["image_id"], axes, ["v"], lambda v: {"out": kernel(v)}, reach, "out double", tile), {k: v.shape for k, v in images.items()}, axes, "out", np.nan)
    assert all(np.allclose(got[k], kernel(v)) for k, v in images.items())


def test_tiles_of_stacks(spark):
    stack = np.random.default_rng(6).normal(size=(5, 14, 11))
    df, axes = frame(spark, {"s": stack}, kind="double")
    got = arrays(by_tile(df, ["image_id"], axes, ["v"], lambda v: {"out": filters.gaussian(v, (0.5, 1.0, 1.0))}, [2, 4, 4], "out double", 4), {"s": stack.shape}, axes, "out")
    assert np.allclose(got["s"], filters.gaussian(stack, (0.5, 1.0, 1.0)))


@pytest.mark.parametrize("factors", [(0.5, 0.25), (1.0, 2.6), (0.3, 1.0), (0.01, 3.0)])
def test_resampling(spark, factors):
    images = {"a": np.random.default_rng(7).normal(size=(13, 20)), "b": np.random.default_rng(8).normal(size=(1, 9))}
    df, axes = frame(spark, images, kind="double")
    want = {k: filters.rescale(v, factors) for k, v in images.items()}
    got = arrays(resampled(df, ["image_id"], axes, list(factors), "v"), {k: v.shape for k, v in want.items()}, axes, "v", np.nan)
    assert all(np.allclose(got[k], want[k]) for k in images)


def kruskal(height, seeds, mask):
    edges = []
    for at in np.ndindex(height.shape):
        for axis in range(height.ndim):
            to = tuple(a + (k == axis) for k, a in enumerate(at))
            if to[axis] < height.shape[axis] and mask[at] and mask[to]:
                edges.append((max(height[at], height[to]), at, axis, to))
    root = {at: at for at in np.ndindex(height.shape)}
    label = {at: int(seeds[at]) for at in root}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for _, a, _, b in sorted(edges):
        a, b = find(a), find(b)
        if a != b and not (label[a] and label[b]):
            a, b = (a, b) if label[a] else (b, a)
            root[b] = a
    return np.array([label[find(at)] if mask[at] else 0 for at in np.ndindex(height.shape)]).reshape(height.shape)


@pytest.mark.parametrize("shape", [(9, 13), (3, 5, 6)])
def test_watershed_is_the_spanning_forest_of_its_seeds(spark, shape):
    rng = np.random.default_rng(len(shape))
    images = {"plateaus": rng.integers(0, 4, shape), "slopes": rng.permutation(int(np.prod(shape))).reshape(shape), "flat": np.zeros(shape, int)}
    rows, axes = None, None
    want = {}
    for name, height in images.items():
        seeds = np.where(rng.random(shape) < 0.06, rng.integers(1, 5, shape), 0)
        mask = rng.random(shape) < 0.85
        own = np.stack([height, np.where(mask, seeds, 0), mask])
        df, axes = frame(spark, {name: height})
        side, _ = frame(spark, {name: own[1]}, "seed")
        inside, _ = frame(spark, {name: mask}, "mask", "boolean")
        df = df.join(side, ["image_id", *axes]).join(inside, ["image_id", *axes]).filter("mask")
        rows = df if rows is None else rows.unionByName(df)
        want[name] = kruskal(height, own[1], mask)
    got = arrays(watershed(rows, ["image_id"], axes, "v", "seed"), {k: v.shape for k, v in images.items()}, axes, "label")
    assert all((got[k] == want[k]).all() for k in images)
    assert watershed(rows.limit(0), ["image_id"], axes, "v", "seed").count() == 0


def test_percentiles_by_selection(spark):
    rng = np.random.default_rng(11)
    groups = {"even": rng.random(5000), "heavy": np.exp(rng.normal(size=4000) * 40), "same": np.full(3000, 7.25), "two": np.r_[np.full(2000, -1.0), np.full(2000, 1e308)], "one": np.array([3.0]), "near": 1 + rng.integers(0, 5, 3000) * 2.0**-52, "wide": np.r_[-1.7e308, 1.7e308, rng.random(3000)]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("even", None), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p853": 0.853, "p100": 1.0}
    got = {r.k: r for r in percentiles(df, ["k"], "v", shares, fit=20, bins=8).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        with np.errstate(over="ignore"):
            want = spark.createDataFrame([(float(v),) for v in vs], "v double").agg(*(F.percentile("v", s).alias(n) for n, s in shares.items())).first()
        assert all(got[k][n] == pytest.approx(want[n], rel=1e-12) for n in shares), k


def test_ranks_by_range(spark):
    df = spark.range(20_000).select((F.xxhash64("id") % 5_000).alias("v")).union(spark.createDataFrame([(None,)], "v long"))
    want = {v: k for k, v in enumerate(sorted(r.v for r in df.distinct().collect() if r.v is not None))}
    got = ranked_values(df, "v", "code")
    assert {r.v: r.code for r in got.collect()} == want
    assert "SinglePartition" not in factorize(df, "v", "code")._jdf.queryExecution().toString()
    coded = factorize(df.withColumn("w", F.lit(1)), "v", "code")
    assert coded.columns == ["v", "w", "code"] and coded.count() == df.count() and coded.filter("v IS NULL AND code IS NULL").count() == 1


def test_edges_know_the_seeds_of_their_ends(spark):
    from lumispark.operators.watershed import _edges

    nodes = spark.createDataFrame([(1, 0, x, x, 1.0 + x, x in (0, 1, 3)) for x in range(5)], "image_id int, y int, x int, node long, h double, seeded boolean")
    got = {(r.a, r.b, r.cost.top, r.seeded_a, r.seeded_b) for r in _edges(nodes, ["image_id"], ["y", "x"], "h").collect()}
    assert got == {(1, 2, 3.0, True, False), (2, 3, 4.0, False, True), (3, 4, 5.0, True, False)}  # 0 and 1 both have seeds
