import numpy as np
import pyspark.sql.functions as F
import pytest

from lumispark.kernels import morphology, segmentation
from lumispark.operators import runs
from lumispark.operators.hulls import hull_pixels, solidities
from tests.test_runs_and_lines import frame


def extents(mask):
    y = np.flatnonzero(mask.any(axis=1))
    return y, mask[y].argmax(axis=1), mask.shape[1] - 1 - mask[y, ::-1].argmax(axis=1)


def test_hulls_of_plain_shapes():
    square = np.ones((4, 6), bool)
    assert hull_pixels(*extents(square)) == 24
    diagonal = np.eye(5, dtype=bool)
    assert hull_pixels(*extents(diagonal)) == 5
    assert hull_pixels(np.array([3]), np.array([7]), np.array([7])) == 1
    corner = np.zeros((20, 20), bool)
    corner[:, 0] = corner[-1] = True
    assert len(np.argwhere(corner)) / hull_pixels(*extents(corner)) == pytest.approx(segmentation.solidity(corner))


def test_solidities_of_many_objects(spark):
    rng = np.random.default_rng(2)
    images = {f"i{k}": (rng.random((26, 31)) < share).astype(int) for k, share in enumerate((0.15, 0.3, 0.38))}
    df, _ = frame(spark, images)
    found = runs.run_objects(runs.runs_of(df, ["image_id"], ["y"], F.when(F.col("v") == 1, True)), ["image_id"], ["y"])
    named = solidities(found, ["image_id"]).join(runs.object_table(found, ["image_id"], ["y"]).select("image_id", "object", "label"), ["image_id", "object"])
    got = {(r.image_id, r.label): (r.area, r.solidity) for r in named.collect()}
    want = {}
    for name, image in images.items():
        labels = morphology.label(image > 0)
        want |= {(name, k): (int((labels == k).sum()), pytest.approx(segmentation.solidity(labels == k))) for k in range(1, labels.max() + 1)}
    assert got == want
