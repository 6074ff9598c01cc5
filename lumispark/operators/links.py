"""Points followed over frames: candidates by grid cells, groups of candidates as keys, frames in turn where a group is large."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispark.kernels import linking
from lumispark.operators.rounds import Keep, connected, drop_path, intermediates, kept, roots_of
from lumispark.streaming.runs import shared_path

#: Points, or candidate pairs of a frame, that a task links at once.
FIT = 50_000
PAIR = "early long, late long"


def candidates(points: DataFrame, keys: list[str], frame: str, axes: list[str], point: str, reach: float, memory: int) -> DataFrame:
    """(early, late, late_frame, square): pairs of points with equal keys, 1 to memory + 1 frames and at most
    reach apart, by their ids, with the squared distance.

    Pairs meet by an equi-join on frame and grid cell, never by all pairs of a frame. Points with a null
    key, frame or place, and places that aren't numbers, are in no pair."""
    side = reach * (1 + 1e-6) or 1.0  # wider than the reach by more than a division can round
    at = [F.col(a).cast("double") for a in axes]
    cells = [F.floor(a / side) for a in at]
    late = points.select(*keys, F.col(frame).cast("long").alias("late_frame"), F.col(point).alias("late"), *(a.alias(f"_b{k}") for k, a in enumerate(at)), *(c.alias(f"_c{k}") for k, c in enumerate(cells)))
    moves = F.explode(F.array(*(F.array(*map(F.lit, m)) for m in product(range(1, memory + 2), *[(-1, 0, 1)] * len(axes)))))
    moved = points.select(*keys, F.col(frame).cast("long").alias("_frame"), F.col(point).alias("early"), *(a.alias(f"_a{k}") for k, a in enumerate(at)), *(c.alias(f"_c{k}") for k, c in enumerate(cells)), moves.alias("_move"))
    early = moved.select(*keys, (F.col("_frame") + F.col("_move")[0]).alias("late_frame"), "early", *(f"_a{k}" for k in range(len(axes))), *((F.col(f"_c{k}") + F.col("_move")[k + 1]).alias(f"_c{k}") for k in range(len(axes))))
    square = sum((F.col(f"_a{k}") - F.col(f"_b{k}")) * (F.col(f"_a{k}") - F.col(f"_b{k}")) for k in range(len(axes)))
    met = early.join(late.hint("merge"), [*keys, "late_frame", *(f"_c{k}" for k in range(len(axes)))])
    return met.withColumn("square", square).filter(F.col("square") <= reach * reach).select("early", "late", "late_frame", "square")


def _in_turn(near: DataFrame, reach: float, memory: int, fit: int, keep: Keep) -> DataFrame:
    """(node, root) of the points that follow another one, frame by frame over all movies at once.

    What goes from frame to frame is which points have a successor already; of those only the last
    `memory` frames matter. A frame's pairs go to one task while there are few, else by connected group."""
    spark = near.sparkSession
    pairs = keep(near.repartitionByRange("late_frame"), "pairs")  # a frame reads its own files
    frames = [r[0] for r in pairs.select("late_frame").distinct().sort("late_frame").collect()]
    base = shared_path(spark, "followed")

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["early", "late"])
        names, late = np.unique(part["late"], return_inverse=True)
        found = linking.chosen(part["early"].tolist(), late.tolist(), part["square"].tolist(), reach * reach)
        return pd.DataFrame([(a, names[b]) for a, b in found], columns=["early", "late"], dtype="int64")

    for frame in frames:
        open_ = pairs.filter(F.col("late_frame") == frame)
        before = [f"{base}/frame={f}" for f in frames if frame - memory <= f < frame]
        if before:
            open_ = open_.join(spark.read.schema(PAIR).parquet(*before).select("early").hint("merge"), "early", "left_anti")
        open_ = keep(open_, "open")
        shares = -(-open_.count() // max(fit, 1))
        if shares > 1:
            roots = connected(open_.select(F.col("early").alias("a"), F.col("late").alias("b")))
            named = open_.join(roots.hint("merge"), F.col("early") == F.col("node"), "left").withColumn("_group", F.coalesce("root", "early"))
            share = F.pmod(F.xxhash64("_group"), F.lit(shares))
        else:
            named, share = open_, F.lit(0)
        named.select("early", "late", "square", share.alias("_share")).groupBy("_share").applyInPandas(choose, PAIR).write.parquet(f"{base}/frame={frame}")
    followed = spark.read.schema(PAIR).parquet(*(f"{base}/frame={f}" for f in frames)) if frames else spark.createDataFrame([], PAIR)
    out = roots_of(followed.select(F.col("late").alias("node"), F.col("early").alias("parent")), keep)
    drop_path(spark, base)
    return out


def linked(points: DataFrame, movie: str = "movie_id", frame: str = "frame", axes: tuple[str, ...] = ("x", "y"), reach: float = 20.0, memory: int = 2, point: str | None = None, fit: int = FIT) -> DataFrame:
    """points with particle: one-to-one links between frames at the least sum of squares, a particle that
    isn't met costing reach squared and living on for `memory` frames.

    particle is the id of its first point. point names a column of unique whole numbers to take as ids
    (None: ids are dealt, and differ between runs). A column called particle is replaced. Points without
    movie, frame or place are particles of their own; of points at one place ties go by id.

    A movie of up to `fit` points goes to a task as it is. In longer ones, points that candidates connect
    over all frames are linked without the rest of the movie: groups of up to `fit` points go to tasks
    together; larger ones go frame by frame, where only pairs of one frame need to meet. Results don't
    depend on `fit`, which bounds what a task holds. The table is kept in the shared folder."""
    spark = points.sparkSession
    fields = [f"_p{k}" for k in range(len(axes))]
    with intermediates(spark) as keep:
        rows = keep(points.drop("particle").withColumn("_id", F.col(point).cast("long") if point else F.monotonically_increasing_id()), "points")
        places = rows.select(F.col(movie).alias("_movie"), F.col(frame).cast("long").alias("_frame"), *(F.col(a).cast("double").alias(f) for a, f in zip(axes, fields)), "_id")
        fit_ = max(fit, 1)
        real = ["_movie IS NOT NULL AND _frame IS NOT NULL", *(f"{f} IS NOT NULL AND NOT isnan({f})" for f in fields)]
        places = keep(places.filter(" AND ".join(real)), "places")
        movies = keep(places.groupBy("_movie").agg(F.count(F.lit(1)).alias("_many")), "movies")
        dealt = places.join(movies.filter(F.col("_many") <= fit), "_movie").withColumn("_share", F.lit(0).cast("long"))
        in_turn = None
        if movies.filter(F.col("_many") > fit).limit(1).count():
            long_ones = places.join(movies.filter(F.col("_many") > fit).select("_movie"), "_movie", "left_semi")
            near = keep(candidates(long_ones, ["_movie"], "_frame", fields, "_id", reach, memory), "near")
            nodes = near.select(F.col("early").alias("_id")).union(near.select("late")).distinct()
            roots = connected(near.select(F.col("early").alias("a"), F.col("late").alias("b")))
            groups = keep(nodes.join(roots.hint("merge"), F.col("_id") == F.col("node"), "left").select("_id", F.coalesce("root", "_id").alias("_group")), "groups")
            large = keep(groups.groupBy("_group").count().filter(F.col("count") > fit).select("_group"), "large")
            placed = long_ones.join(groups.join(large, "_group", "left_anti").hint("merge"), "_id")
            shares = placed.groupBy("_movie").agg(F.ceil(F.count(F.lit(1)) / fit_).alias("_shares"))
            cut = placed.join(shares, "_movie").withColumn("_share", F.pmod(F.xxhash64("_group"), F.col("_shares")))
            dealt = dealt.drop("_many").unionByName(cut.drop("_group", "_shares"))
            if large.limit(1).count():
                hard = near.join(groups.join(large, "_group", "left_semi").select(F.col("_id").alias("early")).hint("merge"), "early", "left_semi")
                in_turn = _in_turn(hard, reach, memory, fit, keep)

        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["_frame", *reversed(fields), "_id"])
            ids, numbers = part["_id"].to_numpy(), linking.link(part["_frame"].to_numpy(), part[fields].to_numpy(float), reach, memory)
            first = np.unique(numbers, return_index=True)[1]  # numbers are given from 0 on, in order of time
            return pd.DataFrame({"_id": ids, "particle": ids[first][numbers]})

        found = dealt.groupBy("_movie", "_share").applyInPandas(run, "_id long, particle long")
        if in_turn is not None:
            found = found.unionByName(in_turn.select(F.col("node").alias("_id"), F.col("root").alias("particle")))
        out = rows.join(found.hint("merge"), "_id", "left").withColumn("particle", F.coalesce("particle", "_id")).drop("_id")
        return kept(out, "tracks")[0]
