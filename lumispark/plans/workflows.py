"""The workflows: planes or pixels in, measurement tables out.

A kernel sees one image (or one frame) at a time, grouped by its key, so images run side by side and
none is gathered. What relations can say is said as relations: metadata, joins, profiles, curves.
Every image workflow also gives a status table: a failed image has a row there and none among the
measurements.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumispark.functions import classify
from lumispark.functions.numbers import hue, sphere_volume
from lumispark.operators import pixels as pixel_ops
from lumispark.operators import links, stats, tables, tracks
from lumispark.plans import recipes
from lumispark.sources.images import to_array

FAILED = "IMAGE FAILED"


def stack_of(part: pd.DataFrame) -> np.ndarray:
    """(t, z, c, y, x[, sample]) array of an image's planes; raises where planes are missing or repeated."""
    if len(part) != np.prod([part[k].nunique() for k in "tzc"]) or part.duplicated(["t", "z", "c"]).any():
        raise ValueError(f"{len(part)} planes don't fill their frames, slices and channels")
    shape = [int(part[k].max()) + 1 for k in "tzc"]
    first = part.iloc[0]
    plane = to_array(first["dtype"], first["height"], first["width"], first["samples"], first["data"])
    out = np.zeros((*shape, *plane.shape), plane.dtype)
    for r in part.itertuples():
        out[r.t, r.z, r.c] = to_array(r.dtype, r.height, r.width, r.samples, r.data)
    return out


def _range(part: pd.DataFrame) -> list[dict]:
    """Lowest and highest value of the planes."""
    own = [to_array(r.dtype, r.height, r.width, r.samples, r.data) for r in part.itertuples()]
    return [{"low": float(min(p.min() for p in own)), "high": float(max(p.max() for p in own))}]


#: Columns that may hold nulls beside numbers, so that they reach Arrow as they are.
NULLABLE = {"int": "Int32", "bigint": "Int64", "double": "Float64", "boolean": "boolean", "string": "object"}


def _table(names: list[str], schema: str, rows: pd.DataFrame | list[dict]) -> pd.DataFrame:
    kinds = dict(zip(names, (f.strip().split(" ")[1] for f in schema.split(","))))
    table = rows if isinstance(rows, pd.DataFrame) else pd.DataFrame(rows, columns=names)
    return table.reindex(columns=names).astype({n: NULLABLE[k] for n, k in kinds.items()})


def per_image(planes: DataFrame, measure: Callable[[pd.DataFrame], pd.DataFrame | list[dict]], schema: str, keys: tuple[str, ...] = ("image_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows that measure gives for each image, status of each image).

    Both read one pass over the images, kept on the executors' disks (what a lost one held is made
    again; spark.catalog.clearCache() frees them). measure gives few rows as dicts, many as a table."""
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    types = {f: planes.schema[f].dataType.simpleString() for f in keys}

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        try:
            rows, flag, error = _table(fields, schema, measure(part)), "ok", None
        except Exception as e:  # noqa: BLE001  one bad image must not end the others
            rows, flag, error = _table(fields, schema, []), FAILED, "".join(traceback.format_exception_only(e)).strip()
        head = pd.DataFrame([{"_kind": "status", "_flag": flag, "_error": error}]).join(_table(fields, schema, [dict.fromkeys(fields)]))
        out = pd.concat([head, rows.assign(_kind="row", _flag=flag, _error=error)], ignore_index=True)
        return out.assign(**dict(zip(keys, key)))[["_kind", "_flag", "_error", *keys, *fields]]

    out = planes.groupBy(*keys).applyInPandas(run, "_kind string, _flag string, _error string, " + ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema)
    out = out.persist(StorageLevel.DISK_ONLY)
    status = out.filter("_kind = 'status'").select(*keys, F.col("_flag").alias("flag"), F.col("_error").alias("error"))
    return out.filter("_kind = 'row'").select(*keys, *fields), status


def _at(where: np.ndarray, axes: str) -> dict[str, np.ndarray]:
    """Coordinates of the true elements, by axis."""
    return dict(zip(axes, np.nonzero(where)))


def _with_details(df: DataFrame, with_treatment: bool = True) -> DataFrame:
    return df.withColumns(classify.image_details(F.col("image_id"), with_treatment)).withColumnRenamed("image_id", "filename")


def acinus_metrics(planes: DataFrame, nuclear: int = 0, membrane: int = 1, overflow: str = "wrap", rule: recipes.AcinusRule = recipes.AcinusRule()) -> tuple[DataFrame, DataFrame]:
    """filename, vol_um, roundness, flag and what the name says, of z-stacks."""

    def measure(part: pd.DataFrame) -> list[dict]:
        return [recipes.acinus(stack_of(part)[0], float(part["px_um"].iloc[0]), float(part["pz_um"].iloc[0]), nuclear, membrane, overflow, rule)]

    rows, status = per_image(planes, measure, "vol_um double, roundness double, flag string")
    return _with_details(rows), status


def cell_labels(planes: DataFrame, nuclear_binary: DataFrame, membrane_binary: DataFrame, nuclear: int = 0, membrane: int = 1, overflow: str = "wrap") -> tuple[DataFrame, DataFrame]:
    """Voxels (image_id, z, y, x, nucleus, cell, flag, px_um) of nuclei and cells on the shrunk grid.

    The binaries are planes under the same image_id; channel numbers 100 and 101 mark them here."""
    marked = planes.unionByName(nuclear_binary.withColumn("c", F.lit(100))).unionByName(membrane_binary.withColumn("c", F.lit(101)))

    def measure(part: pd.DataFrame) -> list[dict]:
        plain = part[part["c"] < 100]
        px, pz = float(plain["px_um"].iloc[0]), float(plain["pz_um"].iloc[0])
        binaries = [stack_of(part[part["c"] == k].assign(c=0))[0, :, 0] > 0 for k in (100, 101)]
        nuclei, cells, flag = recipes.cells(stack_of(plain)[0], *binaries, px, pz, nuclear, membrane, overflow)
        where = (nuclei > 0) | (cells > 0)
        return pd.DataFrame({**_at(where, "zyx"), "nucleus": nuclei[where], "cell": cells[where], "flag": flag, "px_um": px})

    return per_image(marked, measure, "z int, y int, x int, nucleus int, cell int, flag string, px_um double")


def match_nuclei(voxels: DataFrame, compat: bool = False) -> DataFrame:
    """One row per nucleus in a cell: volumes, ratio, roundnesses, neighbours of the cell.

    A nucleus belongs to the cell at its truncated centroid; one on background has none."""
    keys = ["image_id"]
    shape = lambda c, name: pixel_ops.solids(voxels.withColumn("label", F.col(c)), keys).select("image_id", F.col("label").alias(f"{name}_label"), F.col("volume").alias(f"{name}_volume"), F.col("roundness").alias(f"{name}_roundness"), *([F.col(a) for a in "zyx"] if name == "nucleus" else []))
    nuclei = shape("nucleus", "nucleus")
    under = pixel_ops.labels_at(nuclei, voxels.select(*keys, "z", "y", "x", F.col("cell").alias("cell_label")), keys, ["z", "y", "x"], "truncate", "cell_label").drop("z", "y", "x")
    matched = tables.natural_join(under.filter("cell_label > 0"), shape("cell", "cell"))
    filled = _boxed(voxels)
    beside = pixel_ops.neighbours(filled, keys, ["z", "y", "x"], "cell", compat).withColumnRenamed("cell", "cell_label")
    joined = tables.natural_join(matched, beside)
    size = voxels.groupBy("image_id").agg(F.first("px_um").alias("px_um"), F.first("flag").alias("flag"))
    cube = F.pow(4 * F.col("px_um"), F.lit(3.0))
    return joined.join(size, "image_id").select(
        "image_id", "nucleus_label", "cell_label", F.try_divide("nucleus_volume", F.col("cell_volume")).alias("nucleus_cell_volume_ratio"),
        (F.col("nucleus_volume") * cube).alias("nucleus_volume_um"), (F.col("cell_volume") * cube).alias("cell_volume_um"), "cell_roundness", "nucleus_roundness", "sum", "external", "internal", "flag",
    )


def _boxed(voxels: DataFrame) -> DataFrame:
    """Cells with the background voxels that touch them: six neighbours of each, where no cell is."""
    cells = voxels.filter("cell > 0").select("image_id", "z", "y", "x", "cell")
    steps = [(axis, d) for axis in "zyx" for d in (-1, 1)]
    around = cells.select("image_id", F.explode(F.array(*(F.struct(*((F.col(c) + (d if c == axis else 0)).alias(c) for c in "zyx")) for axis, d in steps))).alias("s"))
    empty = around.select("image_id", "s.z", "s.y", "s.x").distinct().join(cells, ["image_id", "z", "y", "x"], "left_anti")
    return cells.unionByName(empty.withColumn("cell", F.lit(0)))


def cell_analytics(nucleus_cell: DataFrame, max_ratio: float = 0.95, radius_um: float = 13.0, skip_set: str = "Ilk") -> DataFrame:
    """Per-image means of cells with one nucleus, with cell counts and neighbour shares.

    Counts are of all nuclei, before any filter; nuclei per cell are counted after them."""
    named = nucleus_cell.withColumns({"protein_set": classify.protein_set(F.col("filename")), "treatment": classify.drug_treatment(F.col("filename")), "cell_line": classify.cell_line(F.col("filename"))})
    own = named.filter(tables.differs(F.col("protein_set"), skip_set))
    fit = own.filter((F.col("nucleus_cell_volume_ratio") < max_ratio) & (F.col("cell_volume_um") < sphere_volume(radius_um)))
    single = stats.with_group(fit, ["filename", "cell_label"], nuclei=F.count(F.lit(1))).filter("nuclei = 1")
    values = ["nucleus_cell_volume_ratio", "nucleus_volume_um", "cell_volume_um", "cell_roundness", "nucleus_roundness", "sum"]
    means = single.groupBy("filename").agg(*(stats.mean(v).alias(f"mean_{v}") for v in values))
    counts = own.groupBy("filename").agg(F.count(F.lit(1)).alias("number_of_cells"))
    params = own.groupBy("filename", "protein_set", "treatment", "cell_line").agg(F.max("external").alias("external"), F.max("internal").alias("internal"))
    joined = params.join(counts, "filename").join(means, "filename")
    total = F.col("external") + F.col("internal")
    shares = {f"{k}_share": F.try_divide(F.col(k), total) for k in ("external", "internal")}
    return joined.withColumns(shares | {"key": classify.composite_key(F.col("cell_line"), F.col("protein_set"), F.col("treatment"))})


def radial_profiles(planes: DataFrame, nuclear: int, membrane: int, stain: int, solid: bool = True, overflow: str = "wrap", radius_rule: str = "code") -> tuple[DataFrame, DataFrame]:
    """filename, rounded_distance, bm_intensity and what the name says: mean stain by distance to the
    acinus border over its radius. Outside the acinus the stain counts as 0 at distance 0."""
    rule = recipes.AcinusRule(blur=9) if solid else recipes.AcinusRule(blur=3, measure="eccentricity")

    def measure(part: pd.DataFrame) -> list[dict]:
        stack = recipes.filters.to_bytes(stack_of(part)[0])
        both = recipes.channel_sum(stack[:, nuclear], stack[:, membrane], overflow)
        bm = stack[:, stain].astype(float)
        if solid:
            factors = recipes.shrink_factors(float(part["px_um"].iloc[0]), float(part["pz_um"].iloc[0]))
            both, bm = recipes.filters.rescale(both, factors), recipes.filters.rescale(bm, factors)
        else:
            both, bm = both[0], bm[0]
        mask, far, radius, flag = recipes.radial_distances(recipes.filters.clip_quantiles(both.astype(float), 0.10, 0.85), rule, radius_rule=radius_rule)
        if not mask.any():
            raise ValueError("No Area")
        at = np.round(far / radius, 2).ravel()
        places, inverse = np.unique(at, return_inverse=True)
        means = np.bincount(inverse, weights=(bm * mask).ravel()) / np.bincount(inverse)
        return [{"rounded_distance": float(d), "bm_intensity": float(m), "flag": flag} for d, m in zip(places, means)]

    rows, status = per_image(planes, measure, "rounded_distance double, bm_intensity double, flag string")
    return _with_details(rows, with_treatment=False), status


def segment_brightfield(planes: DataFrame, method: str = "intensity", pixel_size: float = 0.82804) -> tuple[DataFrame, DataFrame]:
    """filename, label, area, eccentricity, area_um, segmentation_type and what the name says."""

    def measure(part: pd.DataFrame) -> list[dict]:
        image = stack_of(part)[0, 0, 0]
        labels = recipes.brightfield(recipes.filters.grey(image) if image.ndim > 2 else image, method)
        sizes = recipes.morphology.areas(labels)
        return [{"label": k, "area": int(sizes[k]), "eccentricity": recipes.segmentation.eccentricity(own)} for k, own in recipes.segmentation.objects(labels)]

    rows, status = per_image(planes, measure, "label int, area bigint, eccentricity double")
    name = F.col("image_id")
    described = rows.withColumns({
        "area_um": F.col("area") * pixel_size**2, "segmentation_type": F.lit("intensity" if method == "intensity" else "phase"), "cell_type": classify.cell_type(name),
        "stiffness": classify.stiffness(name), "day": classify.cell_day(name), "day_status": classify.status_of(classify.cell_day(name)),
    })
    return described.withColumnRenamed("image_id", "filename"), status


def segment_nuclei(planes: DataFrame, red: int = 1, green: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pixels (image_id, t, y, x, label, red, green) of two-colour nuclei in each frame: label of the
    nucleus (0 outside), and whether each colour is above its threshold there.

    Each channel is rescaled over the whole movie first, from ranges found by one aggregate."""
    own = planes.filter(F.col("c").isin(red, green))
    ranges, _ = per_image(own, _range, "low double, high double", ("image_id", "c", "t"))
    ranges = ranges.groupBy("image_id", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def measure(part: pd.DataFrame) -> list[dict]:
        colours = []
        for c in (red, green):
            r = part[part["c"] == c].iloc[0]
            plane = to_array(r["dtype"], r["height"], r["width"], r["samples"], r["data"]).astype(float)
            span = r["high"] - r["low"]
            colours.append(((plane - r["low"]) * (255.0 / span)).astype(np.uint8) if span else np.zeros(plane.shape, np.uint8))
        labels = recipes.frame_nuclei(recipes.filters.to_bytes(recipes.channel_sum(*colours)))
        masks = [recipes.frame_mask(c) for c in colours]
        where = (labels > 0) | masks[0] | masks[1]
        return pd.DataFrame({**_at(where, "yx"), "label": labels[where], "red": masks[0][where], "green": masks[1][where]})

    return per_image(own.join(ranges, ["image_id", "c"]), measure, "y int, x int, label int, red boolean, green boolean", ("image_id", "t"))


def link_tracks(points: DataFrame, search_range: float = 20.0, memory: int = 2, movie: str = "movie_id", point: str | None = None) -> DataFrame:
    """points (movie_id, frame, x, y, ...) with particle, the id of its first point: one-to-one between frames."""
    return links.linked(points, movie, "frame", ("x", "y"), search_range, memory, point)


def cycle_tracks(nuclei: DataFrame, n_frames: int, proportion: float = 0.2, search_range: float = 20.0, memory: int = 2) -> DataFrame:
    """Tracks of two-colour nuclei: centroids linked over frames, long ones kept, colour shares of the
    nucleus under each rounded centroid, and its class. is_measured: whether one was there."""
    labelled = nuclei.withColumns({"movie_id": F.col("image_id"), "frame": F.col("t")})
    keys = ["movie_id", "frame"]
    centres = labelled.filter("label > 0").groupBy(*keys, "label").agg(F.avg("y").alias("y"), F.avg("x").alias("x")).drop("label")
    long = tracks.tracks_in_many_frames(link_tracks(centres, search_range, memory), ["movie_id", "particle"], "frame", n_frames, proportion)
    placed = long.withColumns({"y_rounded": F.bround("y", 0).cast("int"), "x_rounded": F.bround("x", 0).cast("int")})
    under = pixel_ops.labels_at(placed, labelled.select(*keys, "y", "x", "label").filter("label > 0"), keys, ["y", "x"], "even")
    shares = pixel_ops.colour_overlap(labelled.filter("label > 0"), [*keys, "label"], F.col("red"), F.col("green")).drop("area")
    measured = under.join(shares, [*keys, "label"], "left").withColumn("is_measured", F.col("pct_yellow").isNotNull())
    return measured.withColumn("color", classify.cycle_colour(F.col("pct_red"), F.col("pct_green"), F.col("pct_yellow")))


def segment_movie_nuclei(planes: DataFrame, channel: int = 0, z_um: float = 6.08, xy_um: float = 0.1700744, power: int = 2) -> tuple[DataFrame, DataFrame]:
    """Voxels (image_id, t, z, y, x, label) of nuclei in stacks over time. The blur crosses frames, so
    a movie is one task."""

    def measure(part: pd.DataFrame) -> list[dict]:
        labels = recipes.movie_nuclei(stack_of(part)[:, :, channel], z_um, xy_um, power)
        return pd.DataFrame({**_at(labels > 0, "tzyx"), "label": labels[labels > 0]})

    return per_image(planes, measure, "t int, z int, y int, x int, label int")


def collagen_pixels(planes: DataFrame, order: str = "rc") -> tuple[DataFrame, DataFrame]:
    """Ring pixels (image_id, y, x, r, g, b, ny, nx, angle, alignment) of RGB planes, colours 0 to 1."""

    def measure(part: pd.DataFrame) -> list[dict]:
        stack = stack_of(part)[0, 0]
        rgb = stack[0] if stack.ndim > 3 else np.moveaxis(stack, 0, -1)
        found, scale = recipes.collagen(rgb, order=order), float(np.iinfo(rgb.dtype).max) if rgb.dtype.kind == "u" else 1.0
        ring = found["ring"]
        return pd.DataFrame({**_at(ring, "yx"), **{k: rgb[..., i][ring] / scale for i, k in enumerate("rgb")}, **{k: found[k][ring] for k in ("ny", "nx", "angle")}})

    rows, status = per_image(planes, measure, ", ".join(f"{k} {t}" for k, t in (("y", "int"), ("x", "int"), *((k, "double") for k in ("r", "g", "b", "ny", "nx", "angle")))))
    return rows.withColumn("alignment", pixel_ops.alignment(F.col("ny"), F.col("nx"), F.col("angle"))), status


def collagen_scores(ring: DataFrame, sample: int = 50, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mean alignment and red to green ratio of each image, a fixed sample of ring pixels of each)."""
    ratio = pixel_ops.hue_ratio(ring, ["image_id"], hue(F.col("r"), F.col("g"), F.col("b")))
    means = ring.groupBy("image_id").agg(F.avg("alignment").alias("mean_alignment"), F.count(F.lit(1)).alias("ring_pixels"))
    order = Window.partitionBy("image_id").orderBy(F.xxhash64("image_id", "y", "x", F.lit(seed)), "y", "x")
    picked = ring.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= sample).drop("_nth")
    return means.join(ratio, "image_id"), picked


def cell_brightness(voxels: DataFrame, identifier: str = "image_id", n_mean: int = 20) -> DataFrame:
    """identifier, frame, label, area, amount_av, amount_pi, mean_av, mean_pi of labelled pixels with
    the two stains beside them: sums, and means of the n brightest pixels."""
    own = voxels.filter("label > 0")
    keys = [identifier, "frame", "label"]
    both = [tracks.brightness(own, keys, s, n_mean).select(*keys, *(["area"] if s == "av" else []), F.col("amount").alias(f"amount_{s}"), F.col("top_mean").alias(f"mean_{s}")) for s in ("av", "pi")]
    return tables.natural_join(*both).withColumnRenamed(identifier, "identifier")


def quantify_death(brightness: DataFrame, n_timesteps: int = 25, metric: str = "mean", pi_threshold: float = 0.3, av_threshold: float = 0.7, percent_frames: float = 50) -> DataFrame:
    """Death curve of each identifier from its cells' brightness; metric is "mean" or "amount"."""
    if metric not in ("mean", "amount"):
        raise ValueError(f"unknown metric {metric}")
    return tracks.death_curve(brightness, n_timesteps, percent_frames, F.col(f"{metric}_av"), F.col(f"{metric}_pi"), av_threshold, pi_threshold, ["identifier"])


def death_by_treatment(curves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotated curves, mean and deviation of pct_total by experiment, treatment and frame)."""
    name = F.col("identifier")
    marked = curves.withColumns({"experiment_id": classify.experiment_id(name), "experiment": classify.death_experiment(name), "treatment": classify.death_treatment(name)})
    return marked, stats.mean_sd(marked, ["experiment", "treatment", "frame"], "pct_total")


def acinus_summary(acini: DataFrame) -> DataFrame:
    """Mean volume and roundness by key, day and condition of each acinus table row's group, once each."""
    named = acini.withColumn("protein_set", classify.protein_set(F.col("filename")))
    keyed = named.withColumn("key", F.concat("protein_set", F.lit(", well"), F.col("well").cast("string"))).filter(tables.differs(F.col("key"), "Lam_Pax, well1"))
    means = keyed.groupBy("key", "protein_set", "well", "day", "condition").agg(stats.mean("vol_um").alias("mean_vol_um"), stats.mean("roundness").alias("mean_roundness"))
    return tables.factorize(means.filter(tables.differs(F.col("protein_set"), "Ilk")), "key", "key_index")


def condition_subsets(wells: DataFrame, wanted: dict[str, list[str]], condition: str = "condition") -> dict[str, DataFrame]:
    """The rows of each named list of conditions."""
    return {name: wells.filter(F.col(condition).isin(values)) for name, values in wanted.items()}


def profile_curves(profiles: DataFrame, below: float = 0.99, window: int = 2) -> DataFrame:
    """Normalised mean profile of each image type, smoothed."""
    normal = stats.normalised_profile(profiles, "filename", "rounded_distance", "bm_intensity", below)
    return stats.mean_profile(normal, "image_type", window)
