"""Local kernels on images of any size: tiles with halos, and separable resampling.

A pixel goes to its tile and to the tiles whose halo it lies in, so a border strip is sent once to
each neighbour. What a task holds for a kernel is one tile with its halo, whatever the image; with a
halo of the kernel's reach the result doesn't depend on where tiles are cut, and at the edge of the
image the kernel sees that edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def by_tile(pixels: DataFrame, keys: list[str], axes: list[str], columns: list[str], kernel: Callable[..., dict[str, np.ndarray]], reach: int | list[int], schema: str, tile: int = TILE) -> DataFrame:
    """(keys, axes and the columns of schema): kernel(array of each column) gives arrays of the same shape
    whose values depend on no pixel farther than reach on an axis. Every pixel of an image needs a row."""
    reaches = dict(zip(axes, [reach] * len(axes) if isinstance(reach, int) else reach))
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    types = [_KINDS[f.strip().split(" ")[1]] for f in schema.split(",")]
    dealt = pixels.select(*keys, *axes, *columns)
    for a in axes:
        low, high = F.floor((F.col(a) - reaches[a]) / tile), F.floor((F.col(a) + reaches[a]) / tile)
        dealt = dealt.withColumn(f"_{a}", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    spots = [f"_{a}" for a in axes]
    gathered = dealt.groupBy(*keys, *spots).agg(F.collect_list(F.struct(*axes, *columns)).alias("_pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_pixels")
            edges = lists.offsets.to_numpy()
            places = [batch.column(s).to_numpy() for s in spots]
            own: list[list[np.ndarray]] = [[] for _ in (*axes, *names)]
            many = []
            for k in range(batch.num_rows):
                flat = lists.values.slice(edges[k], edges[k + 1] - edges[k])
                at = [flat.field(i).to_numpy() for i in range(len(axes))]
                core = np.logical_and.reduce([a // tile == p[k] for a, p in zip(at, places)])
                if core.any():
                    box = tuple(a - a.min() for a in at)
                    planes = []
                    for i in range(len(columns)):
                        values = flat.field(len(axes) + i).to_numpy(zero_copy_only=False)
                        plane = np.zeros([b.max() + 1 for b in box], values.dtype)
                        plane[box] = values
                        planes.append(plane)
                    found = kernel(*planes)
                    for out, values in zip(own, [*(a[core] for a in at), *(found[n][box][core] for n in names)]):
                        out.append(values)
                many.append(int(core.sum()))
            if sum(many):
                which = pa.array(np.repeat(np.arange(batch.num_rows), many))
                kinds = [batch.schema.field("_pixels").type.value_type.field(i).type for i in range(len(axes))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(which) for c in keys), *(pa.array(np.concatenate(o), t) for o, t in zip(own, [*kinds, *types]))], [*keys, *axes, *names]
                )

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    return gathered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*keys, *axes)) + f", {schema}")


def resampled(pixels: DataFrame, keys: list[str], axes: list[str], factors: list[float], value: str) -> DataFrame:
    """(keys, axes, value): linear resampling to round(size * factor) places on each axis, pixel centres
    aligned, no smoothing. Axis by axis a pixel adds its share to the one or more places it lies next
    to; each pass is one sum by place, and the size of an axis is a maximum by image."""
    rows = pixels.select(*keys, *axes, F.col(value).cast("double").alias(value))
    for axis, factor in zip(axes, factors):
        size = rows.groupBy(*keys).agg((F.max(axis) + 1).alias("_size"))
        sized = rows.join(size, keys).withColumn("_new", F.greatest(F.lit(1), F.bround(F.col("_size") * F.lit(float(factor))).cast("int")))
        step = F.col("_new") / F.col("_size")
        first = F.greatest(F.lit(0), F.floor((F.col(axis) - 0.5) * step - 0.5).cast("int"))
        # a pixel at the edge also stands for all places beyond it
        first = F.when(F.col(axis) == 0, F.lit(0)).otherwise(first)
        last = F.when(F.col(axis) == F.col("_size") - 1, F.col("_new") - 1).otherwise(F.least(F.col("_new") - 1, F.ceil((F.col(axis) + 1.5) * step - 0.5).cast("int")))
        spread = sized.withColumn("_to", F.explode(F.sequence(F.least(first, last), last)))
        place = F.least(F.greatest((F.col("_to") + 0.5) * F.col("_size") / F.col("_new") - 0.5, F.lit(0.0)), F.col("_size") - 1.0)
        share = F.lit(1.0) - F.abs(place - F.col(axis))
        others = [a for a in axes if a != axis]
        shared = spread.withColumn("_share", share).filter("_share > 0")
        rows = shared.groupBy(*keys, *others, F.col("_to").alias(axis)).agg(F.sum(F.col("_share") * F.col(value)).alias(value))
    return rows.select(*keys, *axes, value)
