"""Objects from runs and distances by lines against the array kernels, on images that cross tasks."""

import numpy as np
import pyspark.sql.functions as F
import pytest

from lumispark.kernels import distance, morphology
from lumispark.operators import lines, rounds, runs


def frame(spark, images, column="v", kind="int"):
    rows = []
    for name, image in images.items():
        for at in np.ndindex(image.shape):
            rows.append((name, *(int(a) for a in at), image[at].item()))
    axes = ["z", "y", "x"][-image.ndim :]
    return spark.createDataFrame(rows, f"image_id string, {', '.join(f'{a} int' for a in axes)}, {column} {kind}").repartition(7), axes


def arrays(df, shapes, axes, column, fill=0):
    out = {k: np.full(s, fill, float) for k, s in shapes.items()}
    for r in df.collect():
        out[r.image_id][tuple(r[a] for a in axes)] = np.nan if r[column] is None else r[column]
    return out


def spiral(size):
    """One object that winds through the whole image, one pixel wide."""
    out = np.zeros((size, size), int)
    y, x, dy, dx = 0, 0, 0, 1
    out[0, 0] = 1
    for _ in range(size * size):
        ny, nx = y + dy, x + dx
        ahead = 0 <= ny + dy < size and 0 <= nx + dx < size and out[ny + dy, nx + dx]
        if not (0 <= ny < size and 0 <= nx < size) or ahead or out[ny, nx]:
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            if not (0 <= ny < size and 0 <= nx < size) or out[ny, nx] or (0 <= ny + dy < size and 0 <= nx + dx < size and out[ny + dy, nx + dx]):
                break
        y, x = ny, nx
        out[y, x] = 1
    return out


def pictures():
    rng = np.random.default_rng(3)
    return {"empty": np.zeros((5, 7), int), "full": np.ones((4, 9), int), "spiral": spiral(25), "wide": (rng.random((12, 200)) < 0.5).astype(int), "dots": (rng.random((40, 40)) < 0.35).astype(int)}


@pytest.mark.parametrize("connectivity", [1, 2])
def test_labels_and_cleaned_masks(spark, connectivity):
    images = pictures()
    df, axes = frame(spark, images)
    shapes = {k: v.shape for k, v in images.items()}
    got = arrays(runs.labelled_objects(df, ["image_id"], ["y"], F.col("v") == 1, connectivity), shapes, axes, "label")
    assert all((got[k] == morphology.label(v > 0, connectivity)).all() for k, v in images.items())
    cleaned = runs.cleaned_masks(df, ["image_id"], ["y"], F.col("v") == 1, 6, 4, connectivity).cache()
    for column, kernel, least in (("without_small", morphology.without_small, 6), ("without_holes", morphology.without_holes, 4)):
        got = arrays(cleaned, shapes, axes, column)
        assert all((got[k] == kernel(v > 0, least, connectivity)).all() for k, v in images.items())


@pytest.mark.parametrize("connectivity", [1, 2, 3])
def test_solids(spark, connectivity):
    images = {"cube": (np.random.default_rng(connectivity).random((5, 9, 11)) < 0.3).astype(int)}
    df, axes = frame(spark, images)
    got = arrays(runs.labelled_objects(df, ["image_id"], ["z", "y"], F.col("v") == 1, connectivity), {"cube": (5, 9, 11)}, axes, "label")
    assert (got["cube"] == morphology.label(images["cube"] > 0, connectivity)).all()


def test_borders_holes_and_corners(spark):
    images = pictures() | {"ring": np.pad(np.pad(np.zeros((3, 3), int), 1, constant_values=1), 2)}
    images = {k: v for k, v in images.items() if k != "wide"} | {"square": np.pad(np.ones((4, 4), int), 18)}
    df, axes = frame(spark, images)
    shapes = {k: v.shape for k, v in images.items()}
    found = runs.run_objects(runs.runs_of(df, ["image_id"], ["y"], F.col("v") == 1), ["image_id"], ["y"])
    flags = {r.image_id: r.flag for r in runs.hole_flags(found, ["image_id"], ["y"]).collect()}
    assert flags == {k: "Hole" if morphology.label(v == 0).max() > 1 else "None" for k, v in images.items()}
    clear = runs.cleared_objects(found.filter("value AND image_id IN ('dots', 'square')"), ["image_id"], ["y"], {"y": 40, "x": 40})
    got = arrays(runs.run_pixels(clear.withColumn("one", F.lit(1)), ["image_id", "y", "one"]), shapes, axes, "one")
    assert all((got[k] == (morphology.clear_border(morphology.label(images[k] > 0)) > 0)).all() for k in ("dots", "square"))
    wet = arrays(runs.flooded_from_corners(df, ["image_id"], F.col("v") == 0), shapes, axes, "outside")
    assert all((wet[k] == morphology.filled_from_corners(v == 0)).all() for k, v in images.items())


def test_components_of_paths_stars_and_nothing(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(300).tolist()
    links = list(zip(order, order[1:])) + [(1000 + k, 2000) for k in range(50)] + [(7000, 7000), (5000, 5001), (5001, 5000)]
    got = {r.node: r.root for r in rounds.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 0 for k in range(1, 300)} | {k: 1000 for k in [*range(1001, 1050), 2000]} | {5001: 5000}
    assert got == want
    assert rounds.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(labels, spacing):
    out = np.full(labels.shape, np.nan), np.full(labels.shape, np.nan)
    sources = np.argwhere(labels > 0)
    for at in np.ndindex(labels.shape):
        if len(sources):
            square = (((sources - at) * spacing) ** 2).sum(axis=1)
            least = square.min()
            out[0][at], out[1][at] = least, min(labels[tuple(s)] for s in sources[square == least])
    return out


@pytest.mark.parametrize("spacing", [[1.0, 1.0], [2.0, 1.0]])
def test_distances_by_lines(spark, spacing):
    rng = np.random.default_rng(9)
    images = {"none": np.zeros((3, 4), int), "one": np.pad([[5]], ((2, 6), (9, 1))), "many": rng.integers(1, 9, (17, 23)) * (rng.random((17, 23)) < 0.06), "tie": np.array([[2, 0, 0, 0, 1], [0] * 5, [0] * 5, [3, 0, 0, 0, 4]])}
    df, axes = frame(spark, images)
    near = lines.nearest_sources(df, ["image_id"], axes, F.when(F.col("v") > 0, F.col("v")), spacing).cache()
    shapes = {k: v.shape for k, v in images.items()}
    for column, which in (("square", 0), ("label", 1)):
        got = arrays(near, shapes, axes, column)
        assert all(np.array_equal(got[k], brute(v, spacing)[which], equal_nan=True) for k, v in images.items())
    grown = arrays(lines.expanded(df, ["image_id"], axes, "v", 3, spacing), shapes, axes, "v")
    assert all((grown[k] == np.where(brute(v, spacing)[0] <= 9, brute(v, spacing)[1], 0)).all() for k, v in images.items())


def test_distances_in_stacks_with_spacing(spark):
    labels = (np.random.default_rng(2).random((4, 6, 7)) < 0.05).astype(int)
    df, axes = frame(spark, {"s": labels})
    got = arrays(lines.nearest_sources(df, ["image_id"], axes, F.when(F.col("v") > 0, 1), [2.5, 1.0, 0.5]), {"s": labels.shape}, axes, "square")["s"]
    assert np.allclose(got, brute(labels, [2.5, 1.0, 0.5])[0])


def test_signed_distances(spark):
    mask = np.random.default_rng(5).random((9, 14)) < 0.5
    df, axes = frame(spark, {"m": mask, "off": np.zeros((2, 2), bool)}, kind="boolean")
    rows = lines.signed_squares(df, ["image_id"], axes, "v").filter("image_id = 'm'").collect()
    want = distance.signed_distances(mask)
    assert all(np.isclose(-np.sqrt(r.inside) if r.v else np.sqrt(r.outside), want[r.y, r.x]) for r in rows)
