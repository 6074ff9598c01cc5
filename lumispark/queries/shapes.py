"""Queries that run the planar kernels, each against the definition of what the kernel computes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumispark.kernels import filters, segmentation
from lumispark.operators import lines, outlines, runs
from lumispark.operators import pixels as ops
from lumispark.operators.hulls import solidities
from lumispark.operators.tiles import by_tile, resampled
from lumispark.operators.watershed import watershed
from lumispark.plans.workflows import match_nuclei
from lumispark.queries.images import _FOUR, _MASK, _RUNS, IMAGE, four_levels, otsu_mask, row_runs
from lumispark.queries.kernels import by_image, on_planes
from lumispark.queries.measurements import rounded
from lumispark.queries.standins import PIXELS, pixels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query(
    "q42_small_objects_and_holes",
    f"""WITH RECURSIVE {PIXELS}, {_MASK}, c AS (SELECT image_id, y * 8 + x AS p, y, x, mask FROM msk),
    e AS (SELECT a.image_id, a.p AS a, b.p AS b FROM c a JOIN c b ON a.image_id = b.image_id AND a.mask = b.mask AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
    r(image_id, p, root) AS (SELECT image_id, p, p FROM c UNION SELECT e.image_id, e.b, r.root FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.p WHERE r.root < e.b),
    m AS (SELECT image_id, p, min(root) AS root FROM r GROUP BY ALL), s AS (SELECT image_id, root, count(*) AS n FROM m GROUP BY ALL)
    SELECT c.image_id, y, x, CAST(mask AND n >= 3 AS INT) AS without_small, CAST(mask OR n < 3 AS INT) AS without_holes FROM c JOIN m USING (image_id, p) JOIN s USING (image_id, root)""",
)
def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.cleaned_masks(otsu_mask(spark, sf_dir), IMAGE, ["y"], F.col("mask"), 3, 3)
    return found.select("image_id", "y", "x", F.col("without_small").cast("int"), F.col("without_holes").cast("int"))


@query("q43_large_objects", f"WITH {PIXELS}, {_RUNS} SELECT image_id, y, x, label FROM run WHERE label > 0 QUALIFY count(*) OVER (PARTITION BY image_id, label) >= 3")
def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.large_objects(row_runs(spark, sf_dir), IMAGE, 3).select("image_id", "y", "x", "label")


def _blurred(source: str, values: list[str], name: str) -> str:
    """CTEs that blur columns of an 8 x 8 source: normal weights of sigma 1 out to 4 pixels, the nearest
    pixel beyond an edge."""
    pass_of = lambda of, to, axis, other: f"{to} AS (SELECT a.image_id, a.y, a.x, {', '.join(f'sum(w * b.{v}) AS {v}' for v in values)} FROM {of} a CROSS JOIN wts JOIN {of} b ON b.image_id = a.image_id AND b.{other} = a.{other} AND b.{axis} = least(7, greatest(0, a.{axis} + o)) GROUP BY ALL)"
    weights = "wts AS (SELECT o, exp(-0.5::DOUBLE * o * o) / sum(exp(-0.5::DOUBLE * o * o)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS o))"
    return f"{weights}, {pass_of(source, name + '_y', 'y', 'x')}, {pass_of(name + '_y', name, 'x', 'y')}"


@query("q44_gaussian", f"WITH {PIXELS}, {_blurred('pix', ['v'], 'blur')} SELECT image_id, y, x, round_even(v, 6) AS smooth FROM blur")
def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(by_tile(pixels(spark, sf_dir), IMAGE, ["y", "x"], ["v"], lambda v: {"smooth": filters.gaussian(v, 1.0)}, 4, "smooth double"))


@query(
    "q45_laplace",
    f"""WITH {PIXELS} SELECT image_id, y, x, round_even(4 * v - coalesce(lag(v) OVER h, v) - coalesce(lead(v) OVER h, v) - coalesce(lag(v) OVER k, v) - coalesce(lead(v) OVER k, v), 6) AS edge
    FROM pix WINDOW h AS (PARTITION BY image_id, y ORDER BY x), k AS (PARTITION BY image_id, x ORDER BY y)""",
)
def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(by_tile(pixels(spark, sf_dir), IMAGE, ["y", "x"], ["v"], lambda v: {"edge": filters.laplace(v)}, 1, "edge double"))


@query(
    "q46_rolling_ball",
    f"""WITH {PIXELS}, cap AS (SELECT dy, dx, sqrt(4.0::DOUBLE - dy * dy - dx * dx) - 2 AS z FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE dy * dy + dx * dx <= 4),
    t AS (SELECT a.image_id, a.y, a.x, min(b.v - z) AS v FROM pix a CROSS JOIN cap JOIN pix b ON b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL)
    SELECT a.image_id, a.y, a.x, round_even(max(b.v + z), 6) AS background FROM t a CROSS JOIN cap JOIN t b ON b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL""",
)
def q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(by_tile(pixels(spark, sf_dir), IMAGE, ["y", "x"], ["v"], lambda v: {"background": filters.rolling_ball(v, 2)}, 4, "background double"))


@query(
    "q47_anisotropic_rescale",
    f"""WITH {PIXELS}, py AS (SELECT i AS y, least(greatest((i + 0.5::DOUBLE) * 8 / 6 - 0.5, 0), 7) AS at FROM (SELECT unnest(range(6)) AS i)), px AS (SELECT i AS x, least(greatest((i + 0.5::DOUBLE) * 8 / 4 - 0.5, 0), 7) AS at FROM (SELECT unnest(range(4)) AS i)),
    g AS (SELECT CAST(py.y AS INT) AS y, CAST(px.x AS INT) AS x, floor(py.at) AS y0, least(floor(py.at) + 1, 7) AS y1, py.at - floor(py.at) AS sy, floor(px.at) AS x0, least(floor(px.at) + 1, 7) AS x1, px.at - floor(px.at) AS sx FROM py, px)
    SELECT a.image_id, g.y, g.x, round_even((a.v * (1 - sy) + b.v * sy) * (1 - sx) + (c.v * (1 - sy) + d.v * sy) * sx, 6) AS v FROM g JOIN pix a ON a.y = y0 AND a.x = x0 JOIN pix b ON b.image_id = a.image_id AND b.y = y1 AND b.x = x0 JOIN pix c ON c.image_id = a.image_id AND c.y = y0 AND c.x = x1 JOIN pix d ON d.image_id = a.image_id AND d.y = y1 AND d.x = x1""",
)
def q47(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampled(pixels(spark, sf_dir), IMAGE, ["y", "x"], [0.75, 0.5], "v"))


@query(
    "q48_ring_and_signed_distance",
    f"""WITH {PIXELS}, {_MASK}, d AS (SELECT a.image_id, a.y, a.x, a.mask, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) FILTER (a.mask AND NOT b.mask) AS inside, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) FILTER (NOT a.mask AND b.mask) AS outside FROM msk a JOIN msk b ON a.image_id = b.image_id GROUP BY ALL)
    SELECT image_id, y, x, CAST(coalesce(outside > 1 AND outside <= 4, FALSE) AS INT) AS ring, round_even(CASE WHEN mask THEN -sqrt(CAST(inside AS DOUBLE)) ELSE coalesce(sqrt(CAST(outside AS DOUBLE)), 1048576) END, 6) AS signed_distance FROM d""",
)
def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = lines.signed_squares(otsu_mask(spark, sf_dir), IMAGE, ["y", "x"], "mask")
    ring = F.coalesce((F.col("outside") > 1) & (F.col("outside") <= 4), F.lit(False)).cast("int")
    signed = F.when(F.col("mask"), -F.sqrt("inside")).otherwise(F.coalesce(F.sqrt("outside"), F.lit(1048576.0)))
    return rounded(both.select("image_id", "y", "x", ring.alias("ring"), signed.alias("signed_distance")))


_PEAKS = f"""{PIXELS}, pk AS (SELECT a.image_id, a.y, a.x, a.v FROM pix a JOIN pix b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 JOIN (SELECT image_id, min(v) AS low FROM pix GROUP BY 1) m ON m.image_id = a.image_id
    WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 AND a.v > low GROUP BY ALL HAVING count(*) FILTER (b.v > a.v OR b.v = a.v AND (b.y, b.x) < (a.y, a.x)) = 0), npk AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS INT) AS nth FROM pk)"""


@query("q49_peaks", f"WITH {_PEAKS} SELECT image_id, y, x, nth FROM npk")
def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(y, x, plane):
        found = segmentation.peaks(plane, 1)
        return {"y": found[:, 0], "x": found[:, 1], "nth": np.arange(1, len(found) + 1)}

    return by_image(pixels(spark, sf_dir), ["v"], kernel, "y int, x int, nth int")


@query("q50_seeds", f"WITH {_PEAKS} SELECT a.image_id, a.y, a.x, coalesce(max(nth), 0) AS seed FROM pix a LEFT JOIN npk b ON b.image_id = a.image_id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4 GROUP BY ALL")
def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_planes(pixels(spark, sf_dir), "v", lambda v: segmentation.seeds(v.shape, segmentation.peaks(v, 1), 2), "seed", "int")


@query(
    "q51_flood_from_corners",
    f"""WITH RECURSIVE {PIXELS}, {_MASK}, f(image_id, y, x) AS (SELECT image_id, y, x FROM msk WHERE NOT mask AND y IN (0, 7) AND x IN (0, 7) UNION SELECT m.image_id, m.y, m.x FROM f JOIN msk m ON m.image_id = f.image_id AND NOT m.mask AND abs(m.y - f.y) <= 1 AND abs(m.x - f.x) <= 1)
    SELECT image_id, y, x, CAST(f.y IS NOT NULL AS INT) AS outside FROM msk LEFT JOIN f USING (image_id, y, x)""",
)
def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    flooded = runs.flooded_from_corners(otsu_mask(spark, sf_dir), IMAGE, ~F.col("mask"))
    return flooded.select("image_id", "y", "x", F.col("outside").cast("int"))


@query(
    "q52_fibre_orientation",
    f"""WITH {PIXELS}, g AS (SELECT image_id, y, x, v, lag(v) OVER h AS l, lead(v) OVER h AS r, lag(v) OVER k AS u, lead(v) OVER k AS d FROM pix WINDOW h AS (PARTITION BY image_id, y ORDER BY x), k AS (PARTITION BY image_id, x ORDER BY y)),
    s AS (SELECT image_id, y, x, CASE WHEN l IS NULL THEN r - v WHEN r IS NULL THEN v - l ELSE (r - l) / 2 END AS gx, CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END AS gy FROM g),
    t AS (SELECT image_id, y, x, gx * gx AS axx, gy * gy AS ayy, gx * gy AS axy FROM s), {_blurred("t", ["axx", "ayy", "axy"], "ten")}
    SELECT image_id, y, x, round_even(0.5 * atan2(2 * axy, axx - ayy), 6) AS angle FROM ten""",
)
def q52(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(by_tile(pixels(spark, sf_dir), IMAGE, ["y", "x"], ["v"], lambda v: {"angle": segmentation.orientation(v, 1.0)}, 5, "angle double"))


@query(
    "q53_masked_and_property",
    f"""WITH {PIXELS}, {_FOUR} SELECT image_id, y, x, label, CASE WHEN v > 0 THEN v ELSE 0 END AS inside, CASE WHEN label > 0 THEN count(*) OVER (PARTITION BY image_id, label) END AS area FROM lab""",
)
def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = four_levels(spark, sf_dir)
    mask = labelled.filter("v > 0").select("image_id", "y", "x")
    inside = ops.masked(labelled.withColumnRenamed("v", "inside"), mask, ["image_id", "y", "x"], "inside")
    return ops.with_property(inside, ops.regions(labelled, IMAGE), IMAGE, "area").select("image_id", "y", "x", "label", "inside", "area")


def _cube(z: str, y: str, x: str) -> str:
    return f"vox AS (SELECT image_id, CAST((y * 8 + x) // 16 AS INT) AS {z}, CAST((y * 8 + x) // 4 % 4 AS INT) AS {y}, CAST(x % 4 AS INT) AS {x}, label AS cell, (label + 1) % 4 AS nucleus FROM lab)"


def _solids(column: str, name: str) -> str:
    """CTEs that end in `name`: shapes of the objects of a label column of vox, from their covariance."""
    return f"""{name}_s AS (SELECT image_id, {column} AS label, count(*) AS volume, avg(z) AS z, avg(y) AS y, avg(x) AS x, covar_pop(z, z) AS a, covar_pop(y, y) AS b, covar_pop(x, x) AS c, covar_pop(z, y) AS d, covar_pop(z, x) AS e, covar_pop(y, x) AS f FROM vox WHERE {column} > 0 GROUP BY ALL),
    {name}_m AS (SELECT *, (a + b + c) / 3 AS m, sqrt(((a - m) ** 2 + (b - m) ** 2 + (c - m) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p, a * b * c + 2 * d * e * f - a * f * f - b * e * e - c * d * d AS det, a * b + b * c + a * c - d * d - e * e - f * f AS minors FROM {name}_s),
    {name}_t AS (SELECT *, acos(least(1, greatest(-1, coalesce((det - m * minors + 2 * m ** 3) / nullif(2 * p ** 3, 0), 1)))) / 3 AS t FROM {name}_m),
    {name} AS (SELECT *, m + 2 * p * cos(t) AS high, m + 2 * p * cos(t + 2 * pi() / 3) AS low, (3 * m - high) / nullif(3 * m - low, 0) AS roundness FROM {name}_t)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 64 pixels as cubes of 4, their four levels as cells and, shifted by one, as nuclei."""
    at = F.col("y") * 8 + F.col("x")
    cube = four_levels(spark, sf_dir).select("image_id", F.expr("(y * 8 + x) DIV 16").cast("int").alias("z"), (F.expr("(y * 8 + x) DIV 4") % 4).cast("int").alias("cy"), (at % 4).cast("int").alias("cx"), F.col("label").alias("cell"))
    return cube.select("image_id", "z", F.col("cy").alias("y"), F.col("cx").alias("x"), "cell", ((F.col("cell") + 1) % 4).alias("nucleus"))


def _four(column: str) -> Column:
    """To 4 places after a small step up, so that noise neither decides exact halves nor leaves -0."""
    return F.bround(F.col(column) + F.lit(1e-7), 4)


@query(
    "q54_solids",
    f"""WITH {PIXELS}, {_FOUR}, {_cube("z", "y", "x")}, {_solids("cell", "sol")} SELECT image_id, label, volume, round_even(z + 1e-7::DOUBLE, 4) AS z, round_even(y + 1e-7::DOUBLE, 4) AS y, round_even(x + 1e-7::DOUBLE, 4) AS x, round_even(3 * m - low + 1e-7::DOUBLE, 4) AS inertia_1, round_even(high + low + 1e-7::DOUBLE, 4) AS inertia_2, round_even(3 * m - high + 1e-7::DOUBLE, 4) AS inertia_3, round_even(roundness + 1e-7::DOUBLE, 4) AS roundness FROM sol""",
)
def q54(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.solids(voxels(spark, sf_dir).withColumnRenamed("cell", "label"), IMAGE)
    found = found.withColumns({f"inertia_{k + 1}": F.col("inertia")[k] for k in range(3)})
    return found.select("image_id", "label", "volume", *(_four(c).alias(c) for c in ("z", "y", "x", "inertia_1", "inertia_2", "inertia_3", "roundness")))


@query(
    "q55_match_nuclei",
    f"""WITH {PIXELS}, {_FOUR}, {_cube("z", "y", "x")}, {_solids("nucleus", "nuc")}, {_solids("cell", "cel")},
    adj AS (SELECT a.image_id, a.cell AS a, coalesce(b.cell, 0) AS b FROM vox a CROSS JOIN (VALUES (0, 0, 1), (0, 1, 0), (1, 0, 0), (0, 0, -1), (0, -1, 0), (-1, 0, 0)) AS s(dz, dy, dx) LEFT JOIN vox b ON b.image_id = a.image_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.cell > 0),
    per AS (SELECT image_id, a, count(DISTINCT b) FILTER (b > 0 AND b <> a) AS sum, bool_or(b = 0) AS edge FROM adj GROUP BY ALL),
    nei AS (SELECT *, count(*) FILTER (edge) OVER (PARTITION BY image_id) AS external, count(*) FILTER (NOT edge) OVER (PARTITION BY image_id) AS internal FROM per)
    SELECT n.image_id, n.label AS nucleus_label, c.label AS cell_label, round_even(n.volume / c.volume + 1e-7::DOUBLE, 4) AS nucleus_cell_volume_ratio, round_even(CAST(n.volume AS DOUBLE) + 1e-7::DOUBLE, 4) AS nucleus_volume_um, round_even(CAST(c.volume AS DOUBLE) + 1e-7::DOUBLE, 4) AS cell_volume_um, round_even(c.roundness + 1e-7::DOUBLE, 4) AS cell_roundness, round_even(n.roundness + 1e-7::DOUBLE, 4) AS nucleus_roundness, nei.sum, external, internal, 'None' AS flag
    FROM nuc n JOIN vox v ON v.image_id = n.image_id AND v.z = trunc(n.z) AND v.y = trunc(n.y) AND v.x = trunc(n.x) AND v.cell > 0 JOIN cel c ON c.image_id = n.image_id AND c.label = v.cell JOIN nei ON nei.image_id = n.image_id AND nei.a = v.cell""",
)
def q55(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = voxels(spark, sf_dir).withColumns({"px_um": F.lit(0.25), "flag": F.lit("None")})
    matched = match_nuclei(grid.filter("cell > 0 OR nucleus > 0"))
    return matched.select(*(_four(c).alias(c) if t == "double" else F.col(c) for c, t in matched.dtypes))


@query(
    "q71_watershed",
    f"""WITH RECURSIVE {PIXELS}, low AS (SELECT a.image_id, a.y, a.x, a.v, a.v = min(b.v) AS pit FROM pix a JOIN pix b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.image_id, a.y, a.x, a.v),
    sed AS (SELECT image_id, y * 8 + x AS p, v, CASE WHEN pit THEN row_number() OVER (PARTITION BY image_id, pit ORDER BY y, x) ELSE 0 END AS seed FROM low),
    e AS (SELECT a.image_id, a.p AS a, b.p AS b, greatest(a.v, b.v) AS top, a.p * 2 + CAST(b.p = a.p + 1 AS INT) AS nth FROM sed a JOIN sed b ON b.image_id = a.image_id AND (b.p = a.p + 8 OR b.p = a.p + 1 AND a.p % 8 < 7)),
    f(image_id, lab) AS (SELECT image_id, list(seed ORDER BY p) FROM sed GROUP BY 1 UNION ALL
        SELECT image_id, list_transform(range(64), lambda i: CASE WHEN i = got.p THEN got.seed ELSE lab[i + 1] END) FROM (SELECT f.image_id, f.lab, arg_min(CASE WHEN lab[a + 1] > 0 THEN {{'p': b, 'seed': lab[a + 1]}} ELSE {{'p': a, 'seed': lab[b + 1]}} END, (top, nth)) AS got
            FROM f JOIN e ON e.image_id = f.image_id AND (lab[a + 1] > 0) <> (lab[b + 1] > 0) GROUP BY f.image_id, f.lab)),
    r AS (SELECT image_id, lab, unnest(range(64)) AS p FROM f WHERE NOT list_contains(lab, 0))
    SELECT image_id, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x, CAST(lab[p + 1] AS INT) AS label FROM r""",
)
def q71(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins of the pixels that are the lowest among their neighbours, flooded over the values."""
    near = lambda c, other: F.min(c).over(Window.partitionBy("image_id", other).orderBy("x" if other == "y" else "y").rowsBetween(-1, 1))
    low = pixels(spark, sf_dir, apart=True).withColumn("_row", near("v", "y")).withColumn("_low", near("_row", "x")).withColumn("pit", F.col("v") == F.col("_low"))
    nth = F.row_number().over(Window.partitionBy("image_id", "pit").orderBy("y", "x"))
    return watershed(low.withColumn("seed", F.when(F.col("pit"), nth).otherwise(0)), IMAGE, ["y", "x"], "v", "seed")


@query(
    "q72_solidity",
    f"""WITH RECURSIVE {PIXELS}, {_MASK}, fg AS (SELECT image_id, y * 8 + x AS p, y, x FROM msk WHERE mask),
    e AS (SELECT a.image_id, a.p AS a, b.p AS b FROM fg a JOIN fg b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    r(image_id, p, root) AS (SELECT image_id, p, p FROM fg UNION SELECT e.image_id, e.b, r.root FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.p WHERE r.root < e.b),
    m AS (SELECT image_id, p, min(root) AS root FROM r GROUP BY ALL), o AS (SELECT image_id, root, p // 8 AS y, p % 8 AS x FROM m),
    c AS (SELECT image_id, root, y + dy AS y, min(x - dx) AS lo, max(x + dx) AS hi FROM o CROSS JOIN (VALUES (-0.5::DOUBLE, 0.0::DOUBLE), (0.5, 0), (0, 0.5)) AS d(dy, dx) GROUP BY image_id, root, y + dy),
    h AS (SELECT a.image_id, a.root, t.y, min(CASE WHEN b.y = a.y THEN least(a.lo, b.lo) ELSE a.lo + (b.lo - a.lo) * (t.y - a.y) / (b.y - a.y) END) AS lo, max(CASE WHEN b.y = a.y THEN greatest(a.hi, b.hi) ELSE a.hi + (b.hi - a.hi) * (t.y - a.y) / (b.y - a.y) END) AS hi
        FROM c a JOIN c b ON b.image_id = a.image_id AND b.root = a.root JOIN (SELECT unnest(range(8)) AS y) t ON a.y <= t.y AND b.y >= t.y GROUP BY ALL),
    n AS (SELECT image_id, root, sum(floor(hi + 1e-9::DOUBLE) - ceil(lo - 1e-9::DOUBLE) + 1) AS hull FROM h GROUP BY ALL), k AS (SELECT image_id, root, count(*) AS area FROM o GROUP BY ALL)
    SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY root) AS INT) AS label, area, CAST(hull AS BIGINT) AS hull_area, round_even(area / hull, 6) AS solidity FROM k JOIN n USING (image_id, root)""",
)
def q72(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = runs.runs_of(otsu_mask(spark, sf_dir), IMAGE, ["y"], F.when(F.col("mask"), True))
    found = runs.run_objects(mask, IMAGE, ["y"])
    labels = runs.object_table(found, IMAGE, ["y"]).select("image_id", "object", "label")
    return rounded(solidities(found, IMAGE).join(labels, ["image_id", "object"]).select("image_id", "label", "area", "hull_area", "solidity"))


@query("q75_outlines", f"WITH {PIXELS}, k AS (SELECT image_id, y, count(*) FILTER (v > 0) AS n FROM pix GROUP BY ALL) SELECT image_id, CAST(y AS BIGINT) AS y, CAST(0 AS BIGINT) AS x0, CAST(n AS BIGINT) AS x1 FROM k")
def q75(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's counts of positive values as a shape of bars, traced and filled again."""
    bars = pixels(spark, sf_dir).groupBy("image_id", "y").agg(F.count(F.when(F.col("v") > 0, 1)).alias("n"))
    shape = bars.select("image_id", "y", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("x"))
    return outlines.filled(outlines.outlines(shape, ["image_id"]), ["image_id"])


@query("q76_smoothed_outlines")
def q76(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shapes with their outlines smoothed to a mean squared distance of about a tenth."""
    bars = pixels(spark, sf_dir).groupBy("image_id", "y").agg(F.count(F.when(F.col("v") > 0, 1)).alias("n"))
    shape = bars.select("image_id", "y", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("x"))
    return outlines.filled(outlines.smoothed(outlines.outlines(shape, ["image_id"]), ["image_id"], s=3.0, knots=16), ["image_id"])
