"""Queries on images as rows of pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumispark.functions.classify import cycle_colour
from lumispark.functions.numbers import area_radius, grey, hue, saturation, wrapped_sum
from lumispark.operators import pixels as ops
from lumispark.queries.measurements import rounded, six
from lumispark.queries.standins import PIXELS, pixels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IMAGE = ["image_id"]


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


_RANGE = "rng AS (SELECT image_id, min(v) AS low, max(v) AS high FROM pix GROUP BY 1)"
_HIST = f"{_RANGE}, hist AS (SELECT image_id, low, high, CAST(least(255, coalesce(floor((v - low) / nullif(high - low, 0) * 256), 0)) AS INT) AS bin, count(*) AS n FROM pix JOIN rng USING (image_id) GROUP BY ALL)"
_OTSU = f"""{_HIST}, osum AS (SELECT *, sum(n) OVER r AS w1, sum(n * bin) OVER r AS m1, sum(n) OVER a AS w, sum(n * bin) OVER a AS m FROM hist WINDOW r AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY image_id)),
    osc AS (SELECT *, (CAST(m1 AS DOUBLE) * CAST(w - w1 AS DOUBLE) - CAST(m - m1 AS DOUBLE) * CAST(w1 AS DOUBLE)) ^ 2 / nullif(CAST(w1 AS DOUBLE) * CAST(w - w1 AS DOUBLE), 0) AS score FROM osum),
    ots AS (SELECT image_id, low + (bin + 0.5) * (high - low) / 256 AS threshold FROM osc QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC NULLS LAST, bin) = 1)"""
_MASK = f"{_OTSU}, msk AS (SELECT image_id, y, x, v, v > threshold AS mask FROM pix JOIN ots USING (image_id))"
#: Runs of mask pixels along each row of an image, as labels.
_RUNS = f"""{_MASK}, st AS (SELECT *, CASE WHEN mask AND (x = 0 OR NOT lag(mask) OVER (PARTITION BY image_id ORDER BY y, x)) THEN 1 ELSE 0 END AS s FROM msk),
    run AS (SELECT image_id, y, x, v, CAST(CASE WHEN mask THEN sum(s) OVER (PARTITION BY image_id ORDER BY y, x ROWS UNBOUNDED PRECEDING) ELSE 0 END AS INT) AS label FROM st)"""
_FOUR = f"{_RANGE}, lab AS (SELECT image_id, y, x, v, CAST(least(3, floor((v - low) / (high - low) * 4)) AS INT) AS label FROM pix JOIN rng USING (image_id))"


def otsu_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    pix = pixels(spark, sf_dir)
    return ops.above(pix, ops.otsu(pix, IMAGE, "v"), IMAGE, "v")


def row_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("image_id").orderBy("y", "x")
    begins = F.col("mask") & ((F.col("x") == 0) | ~F.lag("mask").over(over))
    marked = otsu_mask(spark, sf_dir).withColumn("s", F.when(begins, 1).otherwise(0))
    count = F.sum("s").over(over.rowsBetween(Window.unboundedPreceding, 0))
    return marked.select("image_id", "y", "x", "v", F.when(F.col("mask"), count).otherwise(0).cast("int").alias("label"))


def four_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = pixels(spark, sf_dir)
    whole = Window.partitionBy("image_id")
    low, high = F.min("v").over(whole), F.max("v").over(whole)
    level = F.least(F.lit(3), F.floor(F.try_divide(F.col("v") - low, high - low) * 4)).cast("int")
    return ranged.withColumn("label", level)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pixels side by side as red, green and blue, each 0 to 1."""
    pix = ops.rescale_images(pixels(spark, sf_dir), IMAGE, "v", "u").withColumn("c", F.col("x") % 3).filter("x < 6")
    at = F.expr("x DIV 3").cast("int").alias("x")
    pick = lambda k: F.max(F.when(F.col("c") == k, F.col("u") / 255.0))
    return pix.groupBy("image_id", "y", at).agg(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))


_TRIPLES = f"""{_RANGE}, un AS (SELECT image_id, y, x, CAST(trunc((v - low) * 255.0 / nullif(high - low, 0)) AS INT) AS u FROM pix JOIN rng USING (image_id)),
    rgb AS (SELECT image_id, y, CAST(x // 3 AS INT) AS x, max(CASE WHEN x % 3 = 0 THEN u / 255.0::DOUBLE END) AS r, max(CASE WHEN x % 3 = 1 THEN u / 255.0::DOUBLE END) AS g, max(CASE WHEN x % 3 = 2 THEN u / 255.0::DOUBLE END) AS b FROM un WHERE x < 6 GROUP BY ALL),
    hsv AS (SELECT *, CASE WHEN h < 0 THEN h + 1 ELSE h END AS hue FROM (SELECT *, CASE WHEN t = l THEN 0.0 WHEN t = r THEN (g - b) / (t - l) WHEN t = g THEN 2.0 + (b - r) / (t - l) ELSE 4.0 + (r - g) / (t - l) END / 6.0::DOUBLE AS h FROM (SELECT *, greatest(r, g, b) AS t, least(r, g, b) AS l FROM rgb)))"""


@query(
    "q17_rescale_and_wrap",
    f"""WITH {PIXELS}, {_RANGE}, un AS (SELECT image_id, y, x, CAST(trunc((v - low) * 255.0 / nullif(high - low, 0)) AS INT) AS u FROM pix JOIN rng USING (image_id))
    SELECT image_id, y, x, u, CAST((u + lead(u) OVER (PARTITION BY image_id, y ORDER BY x)) % 256 AS INT) AS wrapped FROM un""",
)
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = ops.rescale_images(pixels(spark, sf_dir), IMAGE, "v", "u").drop("v")
    beside = F.lead("u").over(Window.partitionBy("image_id", "y").orderBy("x"))
    return scaled.withColumn("wrapped", wrapped_sum(F.col("u"), beside))


@query(
    "q18_clip_quantiles",
    f"WITH {PIXELS}, q AS (SELECT image_id, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.85) AS b FROM pix GROUP BY 1) SELECT image_id, y, x, round_even(least(greatest(v, a), b), 6) AS clipped FROM pix JOIN q USING (image_id)",
)
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.clip_quantiles(pixels(spark, sf_dir), IMAGE, "v", 0.10, 0.85, "clipped").drop("v"))


@query("q19_otsu", f"WITH {PIXELS}, {_MASK} SELECT image_id, round_even(any_value(threshold), 6) AS threshold, count(*) FILTER (mask) AS n_above FROM msk JOIN ots USING (image_id) GROUP BY 1")
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    pix = pixels(spark, sf_dir)
    thresholds = ops.otsu(pix, IMAGE, "v")
    counts = ops.above(pix, thresholds, IMAGE, "v").groupBy("image_id").agg(F.count(F.when(F.col("mask"), 1)).alias("n_above"))
    return rounded(thresholds.join(counts, "image_id"))


@query(
    "q20_triangle_and_yen",
    f"""WITH {PIXELS}, {_HIST}, dense AS (SELECT image_id, low, high, CAST(range AS INT) AS bin, coalesce(n, 0) AS n FROM rng CROSS JOIN range(256) LEFT JOIN (SELECT image_id, bin AS range, n FROM hist) USING (image_id, range)),
    e AS (SELECT image_id, min(bin) FILTER (n > 0) AS f, max(bin) FILTER (n > 0) AS l, max(n) AS peak FROM dense GROUP BY 1), p AS (SELECT e.*, min(bin) AS pk FROM e JOIN dense d ON d.image_id = e.image_id AND d.n = e.peak GROUP BY ALL),
    t AS (SELECT d.*, CASE WHEN pk - f < l - pk THEN l - bin ELSE bin - f END AS k, CASE WHEN pk - f < l - pk THEN l - pk ELSE pk - f END AS width, peak, f, l FROM dense d JOIN p USING (image_id)),
    tri AS (SELECT image_id, CASE WHEN f = l THEN low ELSE low + (bin + 0.5) * (high - low) / 256 END AS triangle FROM t WHERE k >= 0 AND k < greatest(width, 1) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY peak * k - width * n DESC, k) = 1),
    y AS (SELECT *, CAST(sum(n) OVER r AS DOUBLE) AS c1, CAST(sum(n * n) OVER r AS DOUBLE) AS s1, CAST(sum(n) OVER a AS DOUBLE) AS c, CAST(sum(n * n) OVER a AS DOUBLE) AS s FROM hist WINDOW r AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY image_id)),
    yn AS (SELECT image_id, low + (bin + 0.5) * (high - low) / 256 AS yen FROM y QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY ((c1 * (c - c1)) * (c1 * (c - c1))) / nullif(s1 * (s - s1), 0) DESC NULLS LAST, bin) = 1)
    SELECT image_id, round_even(triangle, 6) AS triangle, round_even(yen, 6) AS yen FROM tri JOIN yn USING (image_id)""",
)
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    pix = pixels(spark, sf_dir)
    both = ops.triangle(pix, IMAGE, "v").withColumnRenamed("threshold", "triangle").join(ops.yen(pix, IMAGE, "v").withColumnRenamed("threshold", "yen"), "image_id")
    return rounded(both)


@query(
    "q21_regions",
    f"""WITH {PIXELS}, {_MASK}, s AS (SELECT image_id, 1 AS label, count(*) AS area, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM msk WHERE mask GROUP BY 1),
    c AS (SELECT *, sxx / n - (sx / n) * (sx / n) AS cxx, syy / n - (sy / n) * (sy / n) AS cyy, sxy / n - (sx / n) * (sy / n) AS cxy FROM s),
    e AS (SELECT *, (cxx + cyy) / 2 + sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy) AS major, greatest((cxx + cyy) / 2 - sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy), 0.0) AS minor FROM c)
    SELECT image_id, label, area, round_even(sy / n, 6) AS y, round_even(sx / n, 6) AS x, round_even(CASE WHEN major > 0 THEN sqrt(greatest(1 - minor / major, 0.0)) ELSE 0.0 END, 6) AS eccentricity, round_even(major, 6) AS major, round_even(minor, 6) AS minor FROM e""",
)
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = otsu_mask(spark, sf_dir).withColumn("label", F.col("mask").cast("int"))
    return rounded(ops.regions(labelled, IMAGE))


@query(
    "q22_largest_inside",
    f"""WITH {PIXELS}, {_RUNS}, inside AS (SELECT * FROM run WHERE label > 0 AND (image_id, label) NOT IN (SELECT (image_id, label) FROM run WHERE label > 0 AND (x IN (0, 7) OR y IN (0, 7)))),
    a AS (SELECT image_id, label, count(*) AS area, min(y) AS y, min(x) AS x FROM inside GROUP BY ALL) SELECT * FROM a QUALIFY rank() OVER (PARTITION BY image_id ORDER BY area DESC) = 1""",
)
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = ops.clear_border(row_runs(spark, sf_dir), IMAGE, {"y": 8, "x": 8})
    largest = ops.largest_objects(inside, IMAGE)
    return largest.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("y"), F.min("x").alias("x"))


@query(
    "q23_neighbours",
    f"""WITH {PIXELS}, {_FOUR}, e0 AS (SELECT p.image_id, p.label AS a, q.label AS b FROM lab p JOIN lab q ON p.image_id = q.image_id AND ((q.y = p.y + 1 AND q.x = p.x) OR (q.y = p.y AND q.x = p.x + 1)) WHERE p.label <> q.label),
    e AS (SELECT DISTINCT * FROM (SELECT image_id, a, b FROM e0 UNION ALL SELECT image_id, b, a FROM e0)), o AS (SELECT DISTINCT image_id, label FROM lab WHERE label > 0),
    p AS (SELECT o.image_id, o.label, count(b) FILTER (b > 0) AS sum, coalesce(bool_or(b = 0), false) AS outer_one FROM o LEFT JOIN e ON e.image_id = o.image_id AND e.a = o.label GROUP BY ALL)
    SELECT image_id, label, sum, count(*) FILTER (outer_one) OVER w AS external, count(*) FILTER (NOT outer_one) OVER w AS internal FROM p WINDOW w AS (PARTITION BY image_id)""",
)
def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.neighbours(four_levels(spark, sf_dir), IMAGE, ["y", "x"])


@query(
    "q24_radial_profile",
    f"WITH {PIXELS} SELECT image_id, round_even(CAST(least(y, x, 7 - y, 7 - x) + 1 AS DOUBLE) / sqrt(3.0::DOUBLE * 64 / pi()), 2) AS rounded_distance, round_even(avg(v), 6) AS intensity FROM pix GROUP BY ALL",
)
def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = (F.least(F.col("y"), F.col("x"), 7 - F.col("y"), 7 - F.col("x")) + 1).cast("double")
    return rounded(ops.radial_profile(pixels(spark, sf_dir), IMAGE, edge, area_radius(F.lit(64.0)), "v"))


@query(
    "q25_alignment",
    f"""WITH {PIXELS}, g AS (SELECT image_id, y, x, v, lag(v) OVER h AS l, lead(v) OVER h AS r, lag(v) OVER k AS u, lead(v) OVER k AS d FROM pix WINDOW h AS (PARTITION BY image_id, y ORDER BY x), k AS (PARTITION BY image_id, x ORDER BY y)),
    d AS (SELECT *, CASE WHEN l IS NULL THEN r - v WHEN r IS NULL THEN v - l ELSE (r - l) / 2 END AS gx, CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END AS gy FROM g),
    n AS (SELECT *, gy / (sqrt(gy * gy + gx * gx) + 1e-8) AS ny, gx / (sqrt(gy * gy + gx * gx) + 1e-8) AS nx, atan2(CAST(y - 3.5 AS DOUBLE), CAST(x - 3.5 AS DOUBLE)) AS t FROM d)
    SELECT image_id, round_even(avg((ny * sin(t) + nx * cos(t)) * (ny * sin(t) + nx * cos(t))), 6) AS alignment FROM n GROUP BY 1""",
)
def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    sloped = ops.gradient(ops.gradient(pixels(spark, sf_dir), IMAGE, "x", ["y"], "v", "gx"), IMAGE, "y", ["x"], "v", "gy")
    outward = F.atan2(F.col("y") - 3.5, F.col("x") - 3.5)
    aligned = ops.unit_normals(sloped, "gy", "gx").withColumn("a", ops.alignment(F.col("ny"), F.col("nx"), outward))
    return aligned.groupBy("image_id").agg(six(F.avg("a")).alias("alignment"))


@query(
    "q26_colour_overlap",
    f"""WITH {PIXELS}, {_FOUR}, o AS (SELECT image_id, label, count(*) AS area, 100.0 * count(*) FILTER (v > 0 AND NOT (y * x) % 3 = 0) / count(*) AS r, 100.0 * count(*) FILTER ((y * x) % 3 = 0 AND NOT v > 0) / count(*) AS g, 100.0 * count(*) FILTER (v > 0 AND (y * x) % 3 = 0) / count(*) AS b FROM lab WHERE label > 0 GROUP BY ALL)
    SELECT image_id, label, area, round_even(r, 6) AS pct_red, round_even(g, 6) AS pct_green, round_even(b, 6) AS pct_yellow, CASE WHEN b > 15 THEN 'yellow' WHEN r > g THEN 'red' ELSE 'green' END AS colour FROM o""",
)
def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = four_levels(spark, sf_dir).filter("label > 0")
    shares = ops.colour_overlap(objects, ["image_id", "label"], F.col("v") > 0, F.col("y") * F.col("x") % 3 == 0)
    return rounded(shares.withColumn("colour", cycle_colour(F.col("pct_red"), F.col("pct_green"), F.col("pct_yellow"))))


@query(
    "q27_hue_ratio",
    f"WITH {PIXELS}, {_TRIPLES}, n AS (SELECT image_id, count(*) FILTER (hue < 0.05 OR hue > 0.95) AS n_red, count(*) FILTER (hue > 0.25 AND hue < 0.45) AS n_green FROM hsv GROUP BY 1) SELECT *, round_even(n_red / (n_green + 1e-5), 6) AS ratio FROM n",
)
def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.hue_ratio(triples(spark, sf_dir), IMAGE, hue(F.col("r"), F.col("g"), F.col("b"))))


@query(
    "q28_grey_and_hue",
    f"WITH {PIXELS}, {_TRIPLES} SELECT image_id, y, x, round_even(0.2125::DOUBLE * r + 0.7154::DOUBLE * g + 0.0721::DOUBLE * b, 6) AS grey, round_even(hue, 6) AS hue, round_even(coalesce((t - l) / nullif(t, 0), 0.0), 6) AS saturation FROM hsv",
)
def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = triples(spark, sf_dir)
    c = [F.col(k) for k in "rgb"]
    return rounded(rgb.select("image_id", "y", "x", grey(*c).alias("grey"), hue(*c).alias("hue"), saturation(*c).alias("saturation")))


@query(
    "q30_labels_at_points",
    f"""WITH {PIXELS}, {_FOUR}, c AS (SELECT image_id, avg(y) * 1.25 AS py, avg(x) * 1.25 AS px FROM lab WHERE label = 1 GROUP BY 1)
    SELECT c.image_id, round_even(py, 6) AS y, round_even(px, 6) AS x, t.label AS truncated, e.label AS even FROM c LEFT JOIN lab t ON t.image_id = c.image_id AND t.y = trunc(py) AND t.x = trunc(px) LEFT JOIN lab e ON e.image_id = c.image_id AND e.y = round_even(py, 0) AND e.x = round_even(px, 0)""",
)
def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = four_levels(spark, sf_dir).drop("v")
    points = labelled.filter("label = 1").groupBy("image_id").agg((F.avg("y") * 1.25).alias("y"), (F.avg("x") * 1.25).alias("x"))
    cut = ops.labels_at(points, labelled, IMAGE, ["y", "x"], "truncate").withColumnRenamed("label", "truncated")
    return rounded(ops.labels_at(cut, labelled, IMAGE, ["y", "x"], "even").withColumnRenamed("label", "even"))


@query(
    "q31_split_and_join",
    f"WITH {PIXELS} SELECT image_id, y AS z, CASE WHEN y < 4 THEN 'top' ELSE 'bottom' END AS half, count(*) AS n, round_even(sum(v), 6) AS total FROM pix GROUP BY ALL",
)
def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = pixels(spark, sf_dir).withColumnRenamed("y", "z")
    cut = ops.split_stack(stack, IMAGE)
    half = lambda name: cut.filter(F.col("half") == name).select("image_id", F.col("z_half").cast("int").alias("z"), "x", "v", "half")
    joined = ops.join_stacks(half("top"), half("bottom"), IMAGE)
    return rounded(joined.groupBy("image_id", "z", "half").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")))
