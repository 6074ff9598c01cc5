"""Masks as rows of runs: (keys, line coordinates, x0, x1) for pixels of one value next to each other.

What asks for connected objects works on runs, and so on far fewer rows than pixels: runs of
neighbouring lines meet by an equi-join on line and cells of columns, objects are the components of
these links, and areas, holes, borders and corners are sums over runs. No image has to fit a task;
an object that lies in many has one id.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumispark.operators.rounds import connected, intermediates, kept

#: Columns of pixels by which runs of neighbouring lines meet.
CELL = 64


def runs_of(pixels: DataFrame, keys: list[str], lines: list[str], value: Column) -> DataFrame:
    """(keys, lines, value, x0, x1, run): pixels of equal value next to each other on a line, whose last axis
    is x. Pixels whose value is null belong to no run; a missing pixel ends one. The group that is
    ordered is a line. run is a number without gaps in meaning only: it differs for each run."""
    rows = pixels.select(*keys, *lines, "x", value.alias("value")).filter(F.col("value").isNotNull())
    nth = F.row_number().over(Window.partitionBy(*keys, *lines, "value").orderBy("x"))
    grouped = rows.withColumn("_island", F.col("x") - nth).groupBy(*keys, *lines, "value", "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return kept(grouped.drop("_island").withColumn("run", F.monotonically_increasing_id()), "runs")[0]


def run_links(runs: DataFrame, keys: list[str], lines: list[str], connectivity: int | None = None) -> DataFrame:
    """Links (a, b) of runs of one value that touch: 1 for faces, the number of axes (the default) for corners too."""
    most = len(lines) + 1 if connectivity is None else connectivity
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(lines)) if s > (0,) * len(lines) and sum(map(abs, s)) <= most]
    cells = lambda reach: F.sequence(F.floor((F.col("x0") - reach) / CELL), F.floor((F.col("x1") + reach) / CELL))
    met = []
    for reach in (0, 1):
        # a corner step along x is left where the lines differ on fewer axes than connect
        own = [s for s in steps if (1 if most > sum(map(abs, s)) else 0) == reach]
        if not own:
            continue
        moved = F.explode(F.array(*(F.struct(*((F.col(c) + d).cast("int").alias(c) for c, d in zip(lines, s))) for s in own)))
        one = runs.select(*keys, "value", F.col("run").alias("a"), (F.col("x0") - reach).alias("from"), (F.col("x1") + reach).alias("to"), F.explode(cells(reach)).alias("cell"), *lines)
        one = one.withColumn("_at", moved).select(*keys, "value", "a", "from", "to", "cell", *(F.col(f"_at.{c}").alias(c) for c in lines))
        two = runs.select(*keys, "value", F.col("run").alias("b"), "x0", "x1", F.explode(cells(0)).alias("cell"), *(F.col(c).cast("int").alias(c) for c in lines))
        met.append(one.join(two, [*keys, "value", "cell", *lines]).filter("x0 <= to AND x1 >= from").select("a", "b"))
    out = met[0]
    for more in met[1:]:
        out = out.unionByName(more)
    return out.distinct()


def run_objects(runs: DataFrame, keys: list[str], lines: list[str], connectivity: int | None = None) -> DataFrame:
    """runs with object: the smallest run of the connected object that the run belongs to."""
    with intermediates(runs.sparkSession) as keep:
        roots = connected(keep(run_links(runs, keys, lines, connectivity), "touching"))
        found = runs.join(roots.select(F.col("node").alias("run"), F.col("root").alias("object")), "run", "left")
        return kept(found.select(*runs.columns, F.coalesce("object", "run").alias("object")), "run-objects")[0]


def object_table(runs: DataFrame, keys: list[str], lines: list[str]) -> DataFrame:
    """(keys, value, object, area, the lowest and highest of each coordinate, label): label numbers the
    objects of a value in each image from 1 in scan order of their first pixels."""
    first = F.min(F.struct(*lines, F.col("x0").alias("x")))
    box = [e for c in lines for e in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"))]
    table = runs.groupBy(*keys, "value", "object").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), first.alias("_first"), *box, F.min("x0").alias("low_x"), F.max("x1").alias("high_x"))
    nth = F.row_number().over(Window.partitionBy(*keys, "value").orderBy("_first"))
    return table.withColumn("label", nth.cast("int")).drop("_first")


def run_pixels(runs: DataFrame, columns: list[str]) -> DataFrame:
    """The pixels of runs with some of their columns."""
    return runs.select(*columns, F.explode(F.sequence("x0", "x1")).alias("x"))


def labelled_objects(pixels: DataFrame, keys: list[str], lines: list[str], mask: Column, connectivity: int | None = None) -> DataFrame:
    """(keys, lines, x, label) of the pixels of the mask, objects numbered as in object_table."""
    runs = run_objects(runs_of(pixels, keys, lines, F.when(mask, True)), keys, lines, connectivity)
    labels = object_table(runs, keys, lines).select(*keys, "object", "label")
    return run_pixels(runs.join(labels, [*keys, "object"]), [*keys, *lines, "label"])


def cleaned_masks(pixels: DataFrame, keys: list[str], lines: list[str], mask: Column, least_object: int, least_hole: int, connectivity: int = 1) -> DataFrame:
    """(keys, lines, x, without_small, without_holes): the mask without objects, and with holes filled, of
    fewer pixels than that; a hole is background that connects, at the border too. The sides are labelled in one go."""
    runs = run_objects(runs_of(pixels, keys, lines, mask), keys, lines, connectivity)
    table = object_table(runs, keys, lines).select(*keys, "object", "area")
    small = F.col("value") & (F.col("area") >= least_object)
    full = F.col("value") | (F.col("area") < least_hole)
    return run_pixels(runs.join(table, [*keys, "object"]).withColumns({"without_small": small, "without_holes": full}), [*keys, *lines, "without_small", "without_holes"])


def cleared_objects(runs: DataFrame, keys: list[str], lines: list[str], sizes: dict[str, int]) -> DataFrame:
    """Runs of the objects that touch no face of the image. sizes: coordinate to its extent."""
    table = object_table(runs, keys, lines)
    inside = F.lit(True)
    for axis, size in sizes.items():
        inside = inside & (F.col(f"low_{axis}") > 0) & (F.col(f"high_{axis}") < size - 1)
    return runs.join(table.filter(inside).select(*keys, "object"), [*keys, "object"], "left_semi")


def hole_flags(runs: DataFrame, keys: list[str], lines: list[str]) -> DataFrame:
    """(keys, flag): "Hole" where the background (runs of value false) is in more than one object, else "None"."""
    many = F.countDistinct(F.when(~F.col("value"), F.col("object")))
    return runs.groupBy(*keys).agg(F.when(many > 1, "Hole").otherwise("None").alias("flag"))


def flooded_from_corners(pixels: DataFrame, keys: list[str], mask: Column, connectivity: int | None = None) -> DataFrame:
    """(keys, y, x, outside): whether a pixel of the mask connects to a corner of its plane; false off the mask."""
    runs = run_objects(runs_of(pixels, keys, ["y"], mask), keys, ["y"], connectivity)
    size = runs.groupBy(*keys).agg(F.max("y").alias("_h"), F.max("x1").alias("_w"))
    corner = F.col("value") & ((F.col("y") == 0) | (F.col("y") == F.col("_h"))) & ((F.col("x0") == 0) | (F.col("x1") == F.col("_w")))
    wet = runs.join(size, keys).filter(corner).select(*keys, "object").distinct().withColumn("_wet", F.lit(True))
    flooded = runs.join(wet, [*keys, "object"], "left").withColumn("outside", F.coalesce("_wet", F.lit(False)))
    return run_pixels(flooded, [*keys, "y", "outside"])
