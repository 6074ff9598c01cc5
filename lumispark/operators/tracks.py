"""Operators on objects followed over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumispark.operators.stats import mean, total


def long_tracks(df: DataFrame, keys: list[str], n_frames: int, percent: float) -> DataFrame:
    """Rows of labels with more rows than the percentage of all frames (strictly)."""
    counted = df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.filter(F.col("_rows") > n_frames * percent / 100).drop("_rows")


def tracks_in_many_frames(df: DataFrame, keys: list[str], frame: str, n_frames: int, proportion: float = 0.2) -> DataFrame:
    """Rows of particles seen in more distinct frames than the proportion (strictly)."""
    many = df.groupBy(*keys).agg(F.countDistinct(frame).alias("_frames")).filter(F.col("_frames") > n_frames * proportion)
    return df.join(many.select(*keys), keys, "left_semi")


def first_crossings(df: DataFrame, keys: list[str], av: Column, pi: Column, av_cutoff: float, pi_cutoff: float, frame: str = "frame") -> DataFrame:
    """First frame at or above each cut-off: av_frame, and pi_frame where it comes before av_frame.

    Within a frame the first stain is looked at first, so a cell that crosses both at once, or the
    first stain earlier, gives no second event; one that crosses the second earlier gives both."""
    at = F.col(frame)
    firsts = df.groupBy(*keys).agg(F.min(F.when(av >= av_cutoff, at)).alias("av_frame"), F.min(F.when(pi >= pi_cutoff, at)).alias("_pi"))
    earlier = F.col("av_frame").isNull() | (F.col("_pi") < F.col("av_frame"))
    return firsts.withColumn("pi_frame", F.when(earlier, F.col("_pi"))).drop("_pi")


def death_curve(
    props: DataFrame,
    n_frames: int,
    percent: float,
    av: Column,
    pi: Column,
    av_cutoff: float,
    pi_cutoff: float,
    identifier: list[str],
    label: str = "label",
) -> DataFrame:
    """Cumulative first crossings of each identifier by frame, as counts and percentages of long tracks.

    Events are counted by frame first, so the running sums see one row a frame and identifier.
    n_dead_distinct counts each cell once, whichever event it had."""
    kept = long_tracks(props, [*identifier, label], n_frames, percent)
    events = first_crossings(kept, [*identifier, label], av, pi, av_cutoff, pi_cutoff)
    tracks = events.groupBy(*identifier).agg(F.count(F.lit(1)).alias("number_of_long_tracks"))
    dead = F.least("av_frame", "pi_frame")
    kinds = {"av": F.col("av_frame"), "pi": F.col("pi_frame"), "any": dead}
    each = events.select(*identifier, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("frame")) for k, c in kinds.items()))).alias("e"))
    per_frame = (
        each.select(*identifier, "e.kind", "e.frame")
        .filter("frame IS NOT NULL")
        .groupBy(*identifier, "frame")
        .agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"_{k}") for k in kinds))
    )
    frames = tracks.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))))
    running = Window.partitionBy(*identifier).orderBy("frame")
    so_far = {"number_av": "_av", "number_pi": "_pi", "n_dead_distinct": "_any"}
    joined = frames.join(per_frame, [*identifier, "frame"], "left")
    counts = joined.select(*identifier, "frame", "number_of_long_tracks", *(F.coalesce(F.sum(c).over(running), F.lit(0)).alias(n) for n, c in so_far.items()))
    percent_of = lambda c: F.try_divide(F.lit(100.0) * c, F.col("number_of_long_tracks"))
    return counts.withColumns({"pct_av": percent_of(F.col("number_av")), "pct_pi": percent_of(F.col("number_pi")), "pct_total": percent_of(F.col("number_av") + F.col("number_pi"))})


def brightness(pixels: DataFrame, keys: list[str], value: str, n_mean: int = 20) -> DataFrame:
    """Count, sum, mean and mean of the n brightest values of each group; a group of fewer than n
    counts the missing ones as 0."""
    sums = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("area"), total(value).alias("amount"), mean(value).alias("mean"))
    # a filter on the rank alone, so that tasks keep n values of a group before anything is sent
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value)))
    top = pixels.select(*keys, value).withColumn("_nth", nth).filter(F.col("_nth") <= n_mean)
    top = top.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg((F.coalesce(total(value), F.lit(0.0)) / n_mean).alias("top_mean"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return sums.join(top, same).select(*keys, "area", "amount", "mean", "top_mean")


def positive_labels(pixels: DataFrame, props: DataFrame, keys: list[str], column: str, cutoff: float, label: str = "label") -> DataFrame:
    """pixels with positive: the label where its measurement is at or above the cut-off, else 0."""
    members = props.filter(F.col(column) >= cutoff).select(*keys).distinct().withColumn("_member", F.lit(True))
    return pixels.join(members, keys, "left").withColumn("positive", F.when(F.col("_member"), F.col(label)).otherwise(F.lit(0))).drop("_member")


def segments(df: DataFrame, keys: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Each point with the next point of its track; the last point of a track starts no segment."""
    over = Window.partitionBy(*keys).orderBy(*order)
    moved = df.withColumns({"next_x": F.lead(x).over(over), "next_y": F.lead(y).over(over)})
    return moved.filter(F.col("next_x").isNotNull())
