"""Convex hulls of planar objects from the ends of their rows, without a grid for any object."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lower_chain(at: np.ndarray, value: np.ndarray) -> tuple[list[float], list[float]]:
    """The corners of the largest convex function below the points; at rises."""
    chain: list[tuple[float, float]] = []
    for p in zip(at.tolist(), value.tolist()):
        while len(chain) > 1 and (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) >= (p[1] - chain[-2][1]) * (chain[-1][0] - chain[-2][0]):
            chain.pop()
        chain.append(p)
    return [p[0] for p in chain], [p[1] for p in chain]


def hull_pixels(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> int:
    """Pixels whose centres lie in the convex hull of the middles of the object's pixel edges.

    y: the object's rows, rising; x0 and x1: its outermost pixels on each. Rows without a pixel may be left out."""
    low = y.min()
    left = np.full(2 * (y.max() - low) + 3, np.inf)
    right = np.full(len(left), -np.inf)
    for step, out in ((0, 0.5), (-1, 0.0), (1, 0.0)):  # the row itself, and half a row above and below
        place = 2 * (y - low) + 1 + step
        np.minimum.at(left, place, x0 - out)
        np.maximum.at(right, place, x1 + out)
    some = np.flatnonzero(np.isfinite(left))
    rows = np.arange(1, len(left), 2)
    begin = np.interp(rows, *_lower_chain(some, left[some]))
    end = -np.interp(rows, *_lower_chain(some, -right[some]))
    return int((np.floor(end + 1e-9) - np.ceil(begin - 1e-9) + 1).sum())


def solidities(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, object, area, hull_area, solidity) of planar objects: runs as run_objects gives them.

    Rows are reduced to their outermost pixels before an object is gathered, so a task holds as many
    numbers as its tallest object has rows. solidity is the area over that of the hull."""
    ends = runs.groupBy(*keys, "object", "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"))
    rows = F.sort_array(F.collect_list(F.struct("y", "x0", "x1")))
    gathered = ends.groupBy(*keys, "object").agg(F.sum("_n").alias("area"), rows.alias("_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_rows")
            edges = lists.offsets.to_numpy()
            y, x0, x1 = (lists.values.field(k).to_numpy().astype(np.int64) for k in range(3))
            many = [hull_pixels(y[a:b], x0[a:b], x1[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "object", "area")), pa.array(many, pa.int64())], [*keys, "object", "area", "hull_area"])

    kinds = {f.name: f.dataType.simpleString() for f in gathered.schema}
    found = gathered.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in (*keys, "object", "area")) + ", hull_area long")
    return found.withColumn("solidity", F.col("area") / F.col("hull_area"))
