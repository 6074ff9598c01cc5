"""Exact Euclidean distances, one axis after the other; what a task holds together is a line.

On the first axis the nearest source lies above or below: two ordered scans along each line. On every
further axis a pixel's best is the least of (far * spacing)^2 plus what was found so far, over the
pixels of its line; lines are gathered as rows, many to an Arrow batch, and moved against themselves
by growing steps until no longer one can help.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _nearer(square: np.ndarray, label: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The least of square + (far * step)^2 along the last axis, with its label; of equals the smaller label."""
    best, name = square.copy(), label.copy()
    some = np.isfinite(square).any(axis=1)
    for far in range(1, square.shape[1]):
        more = (far * step) ** 2
        if not some.any() or more > best[some].max():
            break
        for to, of in ((slice(far, None), slice(None, -far)), (slice(None, -far), slice(far, None))):
            other = square[:, of] + more
            closer = (other < best[:, to]) | ((other == best[:, to]) & (label[:, of] < name[:, to]))
            best[:, to] = np.where(closer, other, best[:, to])
            name[:, to] = np.where(closer, label[:, of], name[:, to])
    return best, name


def _along(rows: DataFrame, keys: list[str], axis: str, step: float) -> DataFrame:
    """rows (keys, axis, square, label) with square and label carried along the axis; keys name a line."""
    lines = rows.groupBy(*keys).agg(F.collect_list(F.struct(axis, "square", "label")).alias("_line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_line")
            flat, edges = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = flat.field(0).to_numpy()
            many = np.diff(edges)
            line = np.repeat(np.arange(len(many)), many)
            low = np.minimum.reduceat(at, edges[:-1]) if len(at) else at
            width = int((at - low[line]).max(initial=-1)) + 1
            square, label = np.full((len(many), width), np.inf), np.zeros((len(many), width), np.int64)
            place = (line, at - low[line] if len(at) else at)
            square[place] = flat.field(1).fill_null(np.inf).to_numpy()
            label[place] = flat.field(2).fill_null(0).to_numpy()
            best, name = _nearer(square, label, step)
            found = best[place]
            columns = [pa.array(at), pa.array(found, mask=np.isinf(found)), pa.array(name[place], mask=np.isinf(found))]
            struct = pa.StructArray.from_arrays(columns, [axis, "square", "label"])
            out = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), out], [*keys, "_line"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", _line array<struct<{axis}:{kinds[axis]},square:double,label:bigint>>"
    return lines.mapInArrow(run, schema).select(*keys, F.explode("_line").alias("_p")).select(*keys, f"_p.{axis}", "_p.square", "_p.label")


def nearest_sources(pixels: DataFrame, keys: list[str], axes: list[str], source: Column, spacing: list[float] | None = None) -> DataFrame:
    """(keys, axes, square, label): squared distance from each pixel to the nearest source of its image, and
    that source's label; null without a source. source: a label above 0, or null off sources. Of sources
    equally far the smaller label wins. Every pixel of the image needs a row; spacing is by axis."""
    steps = dict(zip(axes, spacing or [1.0] * len(axes)))
    first, *rest = axes
    line = Window.partitionBy(*keys, *rest)
    here = F.struct(F.col(first).alias("at"), F.col("_source").alias("label"))
    marked = pixels.select(*keys, *axes, source.cast("long").alias("_source")).withColumn("_here", F.when(F.col("_source").isNotNull(), here))
    up = F.last("_here", ignorenulls=True).over(line.orderBy(first))
    down = F.last("_here", ignorenulls=True).over(line.orderBy(F.desc(first)))
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.pow((F.col(f"{c}.at") - F.col(first)) * F.lit(float(steps[first])), F.lit(2.0)).alias("square"), F.col(f"{c}.label").alias("label")))
    scanned = marked.withColumns({"_up": up, "_down": down}).withColumn("_best", F.least(far("_up"), far("_down")))
    rows = scanned.select(*keys, *axes, F.col("_best.square").alias("square"), F.col("_best.label").alias("label"))
    for axis in rest:
        rows = _along(rows, [*keys, *(a for a in axes if a != axis)], axis, float(steps[axis]))
    return rows.select(*keys, *axes, "square", "label")


def expanded(pixels: DataFrame, keys: list[str], axes: list[str], label: str, reach: float, spacing: list[float] | None = None) -> DataFrame:
    """(keys, axes, label): labels above 0 grown over background within the reach; the nearest wins, of equals the smaller."""
    near = nearest_sources(pixels, keys, axes, F.when(F.col(label) > 0, F.col(label)), spacing)
    return near.withColumn(label, F.when(F.col("square") <= reach * reach, F.col("label")).otherwise(0)).select(*keys, *axes, label)


def signed_squares(pixels: DataFrame, keys: list[str], axes: list[str], mask: str, spacing: list[float] | None = None) -> DataFrame:
    """(keys, axes, mask, inside, outside): squared distances from pixels of the mask to the nearest one off it,
    and from those off it to the nearest one of it; null where the pixel is on the other side or there is none."""
    off = nearest_sources(pixels, keys, axes, F.when(~F.col(mask), 1), spacing).select(*keys, *axes, F.col("square").alias("inside"))
    on = nearest_sources(pixels, keys, axes, F.when(F.col(mask), 1), spacing).select(*keys, *axes, F.col("square").alias("outside"))
    both = pixels.select(*keys, *axes, mask).join(off, [*keys, *axes]).join(on, [*keys, *axes])
    return both.withColumns({"inside": F.when(F.col(mask), F.col("inside")), "outside": F.when(~F.col(mask), F.col("outside"))})
