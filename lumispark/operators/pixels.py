"""Operators on pixels as rows: (image keys, coordinates, value or label).

Every per-image or per-label scan of an array becomes one group-by, so cost follows the number of
pixels and not pixels times labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumispark.functions.numbers import clipped, rescaled
from lumispark.operators.selection import percentiles

BINS = 256


def rescale_images(pixels: DataFrame, keys: list[str], value: str, out: str, top: int = 255) -> DataFrame:
    """Each image's values from its own range to [0, top], truncated; null for a constant image."""
    ranges = pixels.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return pixels.join(ranges, keys).withColumn(out, rescaled(F.col(value), F.col("_low"), F.col("_high"), top)).drop("_low", "_high")


def clip_quantiles(pixels: DataFrame, keys: list[str], value: str, low: float, high: float, out: str) -> DataFrame:
    """Each image's values held between two of its own quantiles."""
    limits = percentiles(pixels, keys, value, {"_low": low, "_high": high})
    return pixels.join(limits, keys).withColumn(out, clipped(F.col(value), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def histogram(pixels: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """(keys, low, high, bin, n): counts in equal bins over each image's range; empty bins have no row."""
    ranges = pixels.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    share = F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low"))
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(share * bins), F.lit(0))).cast("int")
    return pixels.join(ranges, keys).groupBy(*keys, "low", "high", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _centre(bins: int) -> Column:
    return F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins


def _running(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)


def _best_bin(scored: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Centre of the bin with the best score, the first of equals."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), "bin"))
    return scored.withColumn("_nth", best).filter("_nth = 1").select(*keys, _centre(bins).alias("threshold"))


def otsu(pixels: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """Threshold of each image that parts its histogram with the most variance between the sides."""
    h = histogram(pixels, keys, value, bins)
    whole = Window.partitionBy(*keys)
    w, m = F.sum("n").over(_running(keys)), F.sum(F.col("n") * F.col("bin")).over(_running(keys))
    sums = h.withColumns({"w1": w, "m1": m, "w": F.sum("n").over(whole), "m": F.sum(F.col("n") * F.col("bin")).over(whole)})
    w1, w2, m1 = (c.cast("double") for c in (F.col("w1"), F.col("w") - F.col("w1"), F.col("m1")))
    apart = m1 * w2 - (F.col("m") - F.col("m1")).cast("double") * w1
    return _best_bin(sums.withColumn("score", F.try_divide(apart * apart, w1 * w2)), keys, bins)


def yen(pixels: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """Threshold of each image by the entropic correlation of its histogram's sides."""
    h = histogram(pixels, keys, value, bins)
    whole = Window.partitionBy(*keys)
    square = F.col("n") * F.col("n")
    sums = h.withColumns({"c1": F.sum("n").over(_running(keys)), "s1": F.sum(square).over(_running(keys)), "c": F.sum("n").over(whole), "s": F.sum(square).over(whole)})
    c1, c2, s1, s2 = (c.cast("double") for c in (F.col("c1"), F.col("c") - F.col("c1"), F.col("s1"), F.col("s") - F.col("s1")))
    return _best_bin(sums.withColumn("score", F.try_divide((c1 * c2) * (c1 * c2), s1 * s2)), keys, bins)


def triangle(pixels: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """Threshold of each image farthest below the line from its histogram's peak to its longer tail."""
    h = histogram(pixels, keys, value, bins)
    ends = h.groupBy(*keys, "low", "high").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("top"))
    ends = ends.select(*keys, "low", "high", "first", "last", F.col("top.n").alias("peak"), (-F.col("top.b")).alias("peak_at"))
    right = F.col("peak_at") - F.col("first") < F.col("last") - F.col("peak_at")  # the longer tail lies to the right
    width = F.when(right, F.col("last") - F.col("peak_at")).otherwise(F.col("peak_at") - F.col("first"))
    line = ends.withColumns({"right": right, "width": width}).withColumn("x", F.explode(F.sequence(F.lit(0), F.greatest(F.col("width") - 1, F.lit(0)))))
    line = line.withColumn("bin", F.when(F.col("right"), F.col("last") - F.col("x")).otherwise(F.col("first") + F.col("x")))
    filled = line.join(h.select(*keys, "bin", "n"), [*keys, "bin"], "left").withColumn("score", F.col("peak") * F.col("x") - F.col("width") * F.coalesce("n", F.lit(0)))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "x"))
    flat = F.when(F.col("first") == F.col("last"), F.col("low")).otherwise(_centre(bins))
    return filled.withColumn("_nth", best).filter("_nth = 1").select(*keys, flat.alias("threshold"))


def above(pixels: DataFrame, thresholds: DataFrame, keys: list[str], value: str, out: str = "mask") -> DataFrame:
    """Adds whether the value is strictly above its image's threshold."""
    return pixels.join(thresholds, keys).withColumn(out, F.col(value) > F.col("threshold")).drop("threshold")


def regions(pixels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, label, area, y, x, eccentricity, major, minor): planar objects; label 0 is background."""
    sums = {"sx": "x", "sy": "y", "sxx": "x * x", "syy": "y * y", "sxy": "x * y"}
    s = pixels.filter(F.col(label) > 0).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("area"), *(F.sum(F.expr(e)).alias(k) for k, e in sums.items()))
    n = F.col("area").cast("double")
    mx, my = F.col("sx") / n, F.col("sy") / n
    cxx, cyy, cxy = F.col("sxx") / n - mx * mx, F.col("syy") / n - my * my, F.col("sxy") / n - mx * my
    middle, spread = (cxx + cyy) / 2, F.sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy)
    major, minor = middle + spread, F.greatest(middle - spread, F.lit(0.0))
    flat = F.when(major > 0, F.sqrt(F.greatest(1 - minor / major, F.lit(0.0)))).otherwise(F.lit(0.0))
    return s.select(*keys, label, "area", my.alias("y"), mx.alias("x"), flat.alias("eccentricity"), major.alias("major"), minor.alias("minor"))


def solids(voxels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, label, volume, z, y, x, inertia, roundness): inertia holds the eigenvalues of
    trace(C) * Id - C for the covariance C of the object's coordinates, falling; roundness is the
    smallest over the largest, null where that is 0."""
    pairs = [("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x")]
    s = voxels.filter(F.col(label) > 0).groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("volume"), *(F.avg(c).alias(c) for c in "zyx"), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs)
    )
    a, b, c, d, e, f = (F.col(f"c{p}{q}") for p, q in pairs)
    mean = (a + b + c) / 3
    off = d * d + e * e + f * f
    p = F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean) + 2 * off) / 6)
    det = (a - mean) * ((b - mean) * (c - mean) - f * f) - d * (d * (c - mean) - f * e) + e * (d * f - (b - mean) * e)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0))))) / 3
    largest, smallest = mean + 2 * p * F.cos(turn), mean + 2 * p * F.cos(turn + 2 * F.pi() / 3)
    trace = 3 * mean
    middle = trace - largest - smallest
    inertia = F.array(trace - smallest, trace - middle, trace - largest)
    return s.select(*keys, label, "volume", "z", "y", "x", inertia.alias("inertia")).withColumn("roundness", F.try_divide(F.col("inertia")[2], F.col("inertia")[0]))


def largest_objects(labelled: DataFrame, keys: list[str], label: str = "label", ties: str = "all") -> DataFrame:
    """Rows of each image's largest object; of equals all ("all") or the smallest label ("first")."""
    areas = labelled.filter(F.col(label) > 0).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_area"))
    order = [F.desc("_area")] if ties == "all" else [F.desc("_area"), F.col(label)]
    top = areas.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1")
    return labelled.join(top.select(*keys, label), [*keys, label], "left_semi")


def large_objects(labelled: DataFrame, keys: list[str], least: float, label: str = "label") -> DataFrame:
    """Rows of objects with at least `least` pixels."""
    big = labelled.filter(F.col(label) > 0).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_area")).filter(F.col("_area") >= least)
    return labelled.join(big.select(*keys, label), [*keys, label], "left_semi")


def masked(pixels: DataFrame, mask: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values where the mask has a row, 0 elsewhere."""
    inside = mask.select(*keys).distinct().withColumn("_in", F.lit(True))
    return pixels.join(inside, keys, "left").withColumn(value, F.when(F.col("_in"), F.col(value)).otherwise(F.lit(0))).drop("_in")


def with_property(labelled: DataFrame, props: DataFrame, keys: list[str], column: str, label: str = "label") -> DataFrame:
    """Each pixel with a property of its object; null for background."""
    return labelled.join(props.select(*keys, label, column), [*keys, label], "left")


def clear_border(labelled: DataFrame, keys: list[str], sizes: dict[str, int], label: str = "label") -> DataFrame:
    """Rows of objects that touch no face of the image. sizes: coordinate to its extent."""
    on_face = F.lit(False)
    for axis, size in sizes.items():
        on_face = on_face | (F.col(axis) == 0) | (F.col(axis) == size - 1)
    touching = labelled.filter(on_face & (F.col(label) > 0)).select(*keys, label).distinct()
    return labelled.filter(F.col(label) > 0).join(touching, [*keys, label], "left_anti")


def touching_labels(labelled: DataFrame, keys: list[str], axes: list[str], label: str = "label") -> DataFrame:
    """Distinct (keys, a, b), both ways: labels of pixels that share a face, background 0 included."""
    here = labelled.select(*keys, *axes, F.col(label).alias("a"))
    steps = F.array(*(F.struct(*((F.col(c) + (1 if c == axis else 0)).alias(c) for c in axes)) for axis in axes))
    moved = here.select(*keys, "a", F.explode(steps).alias("s")).select(*keys, "a", *(F.col(f"s.{c}").alias(c) for c in axes))
    met = moved.join(here.withColumnRenamed("a", "b"), [*keys, *axes]).filter("a <> b").select(*keys, "a", "b")
    return met.unionByName(met.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def neighbours(labelled: DataFrame, keys: list[str], axes: list[str], label: str = "label", compat: bool = False) -> DataFrame:
    """(keys, label, sum, external, internal): touching labels of each object; and of its image, the
    objects that touch background and those that don't. compat counts each object as its own neighbour."""
    edges = touching_labels(labelled, keys, axes, label)
    objects = labelled.filter(F.col(label) > 0).select(*keys, F.col(label).alias("a")).distinct()
    per = objects.join(edges, [*keys, "a"], "left").groupBy(*keys, "a").agg(F.count(F.when(F.col("b") > 0, 1)).alias("sum"), F.max(F.coalesce(F.col("b") == 0, F.lit(False))).alias("_out"))
    whole = Window.partitionBy(*keys)
    outside = F.count(F.when(F.col("_out"), 1)).over(whole)
    return per.select(*keys, F.col("a").alias(label), (F.col("sum") + int(compat)).alias("sum"), outside.alias("external"), (F.count(F.lit(1)).over(whole) - outside).alias("internal"))


def radial_profile(pixels: DataFrame, keys: list[str], distance: Column, radius: Column, value: str) -> DataFrame:
    """Mean value by distance over radius, to 2 places."""
    at = F.bround(F.try_divide(distance, radius), 2)
    return pixels.groupBy(*keys, at.alias("rounded_distance")).agg(F.avg(value).alias("intensity"))


def gradient(pixels: DataFrame, keys: list[str], axis: str, others: list[str], value: str, out: str) -> DataFrame:
    """Central differences along an axis, one-sided at its ends."""
    over = Window.partitionBy(*keys, *others).orderBy(axis)
    before, after, here = F.lag(value).over(over), F.lead(value).over(over), F.col(value)
    return pixels.withColumn(out, F.when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2))


def unit_normals(pixels: DataFrame, gy: str, gx: str) -> DataFrame:
    """Adds ny and nx: the gradient over its length plus a small constant."""
    length = F.sqrt(F.col(gy) * F.col(gy) + F.col(gx) * F.col(gx)) + F.lit(1e-8)
    return pixels.withColumns({"ny": F.col(gy) / length, "nx": F.col(gx) / length})


def alignment(ny: Column, nx: Column, angle: Column) -> Column:
    """Squared cosine between a normal and an orientation."""
    c = ny * F.sin(angle) + nx * F.cos(angle)
    return c * c


def colour_overlap(pixels: DataFrame, keys: list[str], red: Column, green: Column) -> DataFrame:
    """(keys, area, pct_red, pct_green, pct_yellow): shares of each object in one mask, or in both."""
    both = red & green
    n = F.count(F.lit(1))
    share = lambda c: F.lit(100.0) * F.count(F.when(c, 1)) / n
    return pixels.groupBy(*keys).agg(n.alias("area"), share(red & ~both).alias("pct_red"), share(green & ~both).alias("pct_green"), share(both).alias("pct_yellow"))


def hue_ratio(pixels: DataFrame, keys: list[str], hue: Column) -> DataFrame:
    """Pixels of red hue over pixels of green hue (plus a small constant)."""
    red, green = (hue < 0.05) | (hue > 0.95), (hue > 0.25) & (hue < 0.45)
    n_red, n_green = F.count(F.when(red, 1)), F.count(F.when(green, 1))
    return pixels.groupBy(*keys).agg(n_red.alias("n_red"), n_green.alias("n_green"), (n_red / (n_green + F.lit(1e-5))).alias("ratio"))


def labels_at(points: DataFrame, labelled: DataFrame, keys: list[str], axes: list[str], rounding: str, label: str = "label") -> DataFrame:
    """points with the label under each: coordinates truncated ("truncate") or rounded half to even
    ("even"); null outside the image."""
    to = (lambda c: c.cast("int")) if rounding == "truncate" else (lambda c: F.bround(c, 0).cast("int"))
    placed = points.withColumns({f"_{a}": to(F.col(a)) for a in axes})
    under = labelled.select(*keys, *(F.col(a).alias(f"_{a}") for a in axes), label)
    return placed.join(under, [*keys, *(f"_{a}" for a in axes)], "left").drop(*(f"_{a}" for a in axes))


def split_stack(voxels: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """Adds half ("top" or "bottom"), cut at half the number of slices, rounded half up, and z_half within it."""
    cut = F.floor((F.max(z).over(Window.partitionBy(*keys)) + 1) / 2 + 0.5).cast("int")
    marked = voxels.withColumn("_cut", cut)
    top = F.col(z) < F.col("_cut")
    return marked.withColumns({"half": F.when(top, "top").otherwise("bottom"), "z_half": F.when(top, F.col(z)).otherwise(F.col(z) - F.col("_cut"))}).drop("_cut")


def join_stacks(top: DataFrame, bottom: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """Bottom below top, along z; an image without a top begins at 0."""
    heights = top.groupBy(*keys).agg((F.max(z) + 1).alias("_height"))
    moved = bottom.join(heights, keys, "left").withColumn(z, (F.col(z) + F.coalesce("_height", F.lit(0))).cast("int")).drop("_height")
    return top.unionByName(moved.select(*top.columns))


def whole_channels(stacks: DataFrame, slices: str, channels: int) -> tuple[DataFrame, DataFrame]:
    """(stacks whose slices divide by the channels, the others)."""
    fits = F.coalesce(F.col(slices) % channels == 0, F.lit(False))
    return stacks.filter(fits), stacks.filter(~fits)
