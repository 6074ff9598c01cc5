"""Queries that run array kernels, one image or movie a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumispark.kernels import morphology
from lumispark.operators import lines, runs
from lumispark.operators.links import candidates
from lumispark.operators.tiles import by_tile
from lumispark.operators.tracks import tracks_in_many_frames
from lumispark.plans.workflows import link_tracks
from lumispark.queries.images import _FOUR, _MASK, IMAGE, four_levels, otsu_mask
from lumispark.queries.measurements import rounded
from lumispark.queries.standins import PIXELS, TRACKS, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def by_image(df: DataFrame, columns: list[str], kernel: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(image_id and what a kernel gives) for each image: kernel(y, x, plane of each column) returns
    equally long columns; pixels without a row are 0. Images are gathered before Python sees them, so
    one Arrow batch holds many."""
    gathered = df.groupBy("image_id").agg(F.collect_list(F.struct("y", "x", *columns)).alias("_pixels"))
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    types = [kinds[f.strip().split(" ")[1]] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_pixels")
            flat, edges = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            parts = [flat.field(k).to_numpy() for k in range(2 + len(columns))]
            found, many = [], []
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                y, x, *values = (p[low:high] for p in parts)
                planes = [np.zeros((y.max() + 1, x.max() + 1), v.dtype) for v in values]
                for plane, v in zip(planes, values):
                    plane[y, x] = v
                found.append(kernel(y, x, *planes))
                many.append(len(found[-1][names[0]]))
            if found:
                ids = np.repeat(batch.column("image_id").to_numpy(), many)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.concatenate([f[n] for f in found]), t) for n, t in zip(names, types))], ["image_id", *names])

    return gathered.mapInArrow(run, f"image_id bigint, {schema}")


def on_planes(df: DataFrame, column: str, kernel: Callable[[np.ndarray], np.ndarray], out: str, kind: str) -> DataFrame:
    """Applies a kernel to each image's (y, x) array of a column."""
    return by_image(df, [column], lambda y, x, plane: {"y": y, "x": x, out: kernel(plane)[y, x].astype(float if kind == "double" else int)}, f"y int, x int, {out} {kind}")


@query(
    "q35_components",
    f"""WITH RECURSIVE {PIXELS}, {_MASK}, fg AS (SELECT image_id, y * 8 + x AS p, y, x FROM msk WHERE mask),
    e AS (SELECT a.image_id, a.p AS a, b.p AS b FROM fg a JOIN fg b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    r(image_id, p, root) AS (SELECT image_id, p, p FROM fg UNION SELECT e.image_id, e.b, r.root FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.p WHERE r.root < e.b),
    m AS (SELECT image_id, p, min(root) AS root FROM r GROUP BY ALL)
    SELECT image_id, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INT) AS label FROM m""",
)
def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.labelled_objects(otsu_mask(spark, sf_dir), IMAGE, ["y"], F.col("mask"))


@query("q36_linking")
def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tracks(spark, sf_dir).select(F.col("event_type").alias("movie_id"), "frame", "event_id", F.col("value").alias("x"), (F.col("label") * 10.0).alias("y"))
    return link_tracks(points, point="event_id")


@query(
    "q73_clear_links",
    f"""WITH {TRACKS}, c AS (SELECT a.event_id AS event_id, b.event_id AS next_id FROM trk a JOIN trk b ON a.event_type = b.event_type AND b.frame = a.frame + 1 AND (a.value - b.value) * (a.value - b.value) + (a.label * 10.0::DOUBLE - b.label * 10.0::DOUBLE) * (a.label * 10.0::DOUBLE - b.label * 10.0::DOUBLE) <= 400),
    k AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS ahead, count(*) OVER (PARTITION BY next_id) AS behind FROM c)
    SELECT t.event_id, k.next_id FROM trk t LEFT JOIN k USING (event_id) WHERE k.next_id IS NULL OR ahead = 1 AND behind = 1""",
)
def q73(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from frame to frame of the events that leave no choice: one partner that has no other, or none."""
    points = tracks(spark, sf_dir).select(F.col("event_type").alias("movie_id"), "frame", "event_id", F.col("value").alias("x"), (F.col("label") * 10.0).alias("y"))
    near = candidates(points, ["movie_id"], "frame", ["x", "y"], "event_id", 20.0, 0)
    ahead = near.groupBy(F.col("early").alias("event_id")).agg(F.count(F.lit(1)).alias("ahead"), F.max("late").alias("_late"))
    behind = near.groupBy(F.col("late").alias("_late")).agg(F.count(F.lit(1)).alias("behind"))
    choice = ahead.join(behind.hint("merge"), "_late").filter("ahead > 1 OR behind > 1").select("event_id")
    following = F.lead("event_id").over(Window.partitionBy("particle").orderBy("frame"))
    return link_tracks(points, memory=0, point="event_id").select("event_id", following.alias("next_id")).join(choice.hint("merge"), "event_id", "left_anti")


@query(
    "q37_distances",
    f"""WITH {PIXELS}, {_MASK}, d AS (SELECT a.image_id, a.y, a.x, a.mask, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) FILTER (NOT b.mask) AS s FROM msk a JOIN msk b ON a.image_id = b.image_id GROUP BY ALL)
    SELECT image_id, y, x, round_even(CASE WHEN mask THEN sqrt(CAST(s AS DOUBLE)) ELSE 0 END, 6) AS distance FROM d""",
)
def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = otsu_mask(spark, sf_dir)
    far = lines.nearest_sources(mask, IMAGE, ["y", "x"], F.when(~F.col("mask"), 1))
    return rounded(far.select("image_id", "y", "x", F.sqrt("square").alias("distance")))


@query(
    "q38_morphology",
    f"""WITH {PIXELS}, {_MASK}, o AS (SELECT a.image_id, a.y, a.x, bool_or(b.mask) AS dilated, bool_and(b.mask) AS eroded FROM msk a JOIN msk b ON a.image_id = b.image_id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4 GROUP BY ALL)
    SELECT image_id, y, x, CAST(dilated AS INT) * 2 + CAST(eroded AS INT) AS state FROM o""",
)
def q38(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = morphology.ball(2, 2)
    mask = otsu_mask(spark, sf_dir).withColumn("mask", F.col("mask").cast("int"))
    return by_tile(mask, IMAGE, ["y", "x"], ["mask"], lambda m: {"state": morphology.dilate(m, disk) * 2 + morphology.erode(m, disk)}, 2, "state int")


@query(
    "q40_expanded_labels",
    f"""WITH {PIXELS}, {_FOUR}, s AS (SELECT * FROM lab WHERE label = 3), d AS (SELECT a.image_id, a.y, a.x, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS far FROM lab a LEFT JOIN s b ON a.image_id = b.image_id GROUP BY ALL)
    SELECT image_id, y, x, CASE WHEN far <= 4 THEN 3 ELSE 0 END AS label FROM d""",
)
def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = four_levels(spark, sf_dir).select("image_id", "y", "x", F.when(F.col("label") == 3, 3).otherwise(0).alias("seed"))
    return lines.expanded(seeds, IMAGE, ["y", "x"], "seed", 2).select("image_id", "y", "x", F.col("seed").cast("int").alias("label"))


@query(
    "q41_track_frames",
    f"WITH {TRACKS} SELECT label, frame, count(*) AS n FROM trk WHERE label IN (SELECT label FROM trk GROUP BY 1 HAVING count(DISTINCT frame) > 30 * 0.85) GROUP BY ALL",
)
def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks_in_many_frames(tracks(spark, sf_dir), ["label"], "frame", 30, 0.85).groupBy("label", "frame").agg(F.count(F.lit(1)).alias("n"))
