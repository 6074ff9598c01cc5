"""Summaries: what plots of groups show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Numbers below FINE are summed in whole steps of 1 / COARSE, the rest of each in steps of 1 / (COARSE * MIDDLE).
FINE, COARSE, MIDDLE = float(1 << 20), float(1 << 12), float(1 << 28)


def total(value: Column | str) -> Column:
    """Sum of a column of numbers, null without any, the same in whatever order the rows come.

    A number is cut into whole steps, which add up without rounding, and a remainder below 2^-40, whose
    sum is too small for its rounding to show. Numbers of 2^20 or more and those that aren't finite are
    summed plainly; a group may hold 2^31 rows. For aggregations, not for windows."""
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    steps = F.when(F.abs(number) < FINE, number) * COARSE
    whole = steps.cast("long")
    rest = (steps - whole) * MIDDLE
    middle = rest.cast("long")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    small = (zero(middle) + zero(rest - middle)) / (COARSE * MIDDLE)
    far = zero(F.when(~(F.abs(number) < FINE), number))
    return F.when(F.count(number) > 0, far + (zero(whole) / COARSE + small))


def mean(value: Column | str) -> Column:
    """Mean of a column of numbers by their total: a cut-off or a place to round at that it meets exactly
    is met in every run, whatever the order of rows."""
    number = F.col(value) if isinstance(value, str) else value
    return F.try_divide(total(number), F.count(number))


def iqr_columns(value: Column, name: str) -> list[Column]:
    """Mean and outer quartiles; nulls are left out, null without a value."""
    return [mean(value).alias(f"mean_{name}"), F.percentile(value, 0.25).alias(f"q1_{name}"), F.percentile(value, 0.75).alias(f"q3_{name}")]


def iqr_summary(wide: DataFrame, group: str, wells: list[str]) -> DataFrame:
    """Mean and quartiles of each well's column by group, and of all wells pooled.

    The pooled side is a left join, so a group without any value keeps its row."""
    each = wide.groupBy(group).agg(*(c for w in wells for c in iqr_columns(F.col(w), w)))
    long = wide.select(group, *wells).unpivot([group], wells, "well", "value")
    pooled = long.groupBy(group).agg(*iqr_columns(F.col("value"), "pooled"))
    return each.join(pooled, group, "left")


def error_bars(summary: DataFrame, name: str) -> DataFrame:
    """Lengths of the lower and upper error bars around the mean, not below 0."""
    mean, low, high = (F.col(f"{k}_{name}") for k in ("mean", "q1", "q3"))
    zero = F.lit(0.0)
    return summary.withColumns({f"below_{name}": F.when(mean.isNotNull(), F.greatest(mean - low, zero)), f"above_{name}": F.when(mean.isNotNull(), F.greatest(high - mean, zero))})


def mean_sd(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return df.groupBy(*groups).agg(mean(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def box_stats(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Quartiles of boxes and violins, with range and count."""
    q = [F.percentile(value, k).alias(n) for k, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return df.groupBy(*groups).agg(*q, F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def with_group(df: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """Adds aggregates of each row's group, by one window per key."""
    over = Window.partitionBy(*keys)
    return df.withColumns({k: c.over(over) for k, c in columns.items()})


def rolling_mean(df: DataFrame, keys: list[str], order: str, value: str, window: int, out: str) -> DataFrame:
    """Mean over each row and the window - 1 before it; null until the window is full."""
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - window, 0)
    return df.withColumn(out, F.when(F.count(value).over(over) == window, F.avg(value).over(over)))


def normalised_profile(df: DataFrame, key: str, distance: str, intensity: str, below: float = 0.99) -> DataFrame:
    """Distance from 0 to 1 within each key, rounded to 2 places and cut below a limit; then intensity
    over its maximum among what is left. A key with one distance only drops out."""
    both = with_group(df, [key], _low=F.min(distance), _high=F.max(distance))
    scaled = both.withColumn("position", F.bround(F.try_divide(F.col(distance) - F.col("_low"), F.col("_high") - F.col("_low")), 2))
    kept = scaled.filter(F.col("position") < below).drop("_low", "_high")
    topped = with_group(kept, [key], _top=F.max(intensity))
    return topped.withColumn("relative", F.try_divide(F.col(intensity), F.col("_top"))).drop("_top")


def mean_profile(normalised: DataFrame, group: str, window: int = 2) -> DataFrame:
    """Mean relative intensity by group and position, smoothed within each group."""
    means = normalised.groupBy(group, "position").agg(mean("relative").alias("mean_relative"))
    return rolling_mean(means, [group], "position", "mean_relative", window, "smoothed")
