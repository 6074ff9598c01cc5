"""Exact percentiles by selection, ranks by range: order statistics without a group's values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumispark.operators.rounds import intermediates, kept

#: Bins that a bracket is cut into each round, and values it may hold to be sorted in a task.
BINS, FIT = 1024, 10_000


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], fit: int = FIT, bins: int = BINS) -> DataFrame:
    """(keys, a column for each of shares): exact percentiles with linear interpolation, as percentile() gives.

    Each share of each key has a bracket that holds its value. A round counts the bracket's values in
    equal bins, with the least and the largest of each bin, and goes on with the bin that the rank falls
    into; a bin's ends are values of the data, so brackets shrink whatever the distribution. A bracket
    of `fit` values or fewer is sorted; one of a single value is done. Nulls and NaN are left out."""
    with intermediates(df.sparkSession) as keep:
        rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
        ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(share)).alias("share")) for name, share in shares.items())))
        state = ends.withColumn("_s", asked).select(*keys, "_s.name", (F.col("_s.share") * (F.col("n") - 1)).alias("place"), "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), "n")
        state = keep(state.withColumn("rank", F.floor("place")), "brackets")
        wide = (F.col("inside") > fit) & (F.col("low") < F.col("high"))
        while state.filter(wide).limit(1).count():
            part = F.col("_v") / 2 - F.col("low") / 2  # halves: the range of doubles may not fit a double
            at = F.least(F.lit(bins - 1), F.floor(part / (F.col("high") / 2 - F.col("low") / 2) * bins)).alias("bin")
            met = rows.join(state.filter(wide), keys).filter("_v >= low AND _v <= high")
            counts = met.groupBy(*keys, "name", "place", "rank", "before", "n", at).agg(F.count(F.lit(1)).alias("many"), F.min("_v").alias("low"), F.max("_v").alias("high"))
            below = F.sum("many").over(Window.partitionBy(*keys, "name").orderBy("bin")) - F.col("many")
            placed = counts.withColumn("before", F.col("before") + below).filter("rank >= before AND rank < before + many")
            state = keep(state.filter(~wide).unionByName(placed.select(*keys, "name", "place", "low", "high", "before", F.col("many").alias("inside"), "n", "rank")), "brackets")
        one = state.filter("low = high").select(*keys, "name", "place", "rank", F.col("low").alias("lower"), (F.col("before") + F.col("inside") - 1).alias("_last"))
        some = rows.join(state.filter("low < high"), keys).filter("_v >= low AND _v <= high").groupBy(*keys, "name", "place", "rank", "before", "inside").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        picked = some.select(*keys, "name", "place", "rank", F.get("_all", (F.col("rank") - F.col("before")).cast("int")).alias("lower"), F.get("_all", (F.col("rank") - F.col("before") + 1).cast("int")).alias("upper"))
        same = one.select(*keys, "name", "place", "rank", "lower", F.when(F.col("_last") > F.col("rank"), F.col("lower")).alias("upper"))
        found = keep(picked.unionByName(same), "picked")
        # the next value up where the bracket ends with the rank's own
        open_ = found.filter("upper IS NULL AND place > rank")
        above = rows.join(open_, keys).filter("_v > lower").groupBy(*keys, "name").agg(F.min("_v").alias("_next"))
        whole = found.join(above, [*keys, "name"], "left")
        upper, share = F.coalesce("upper", "_next", "lower"), F.col("place") - F.col("rank")
        mixed = whole.select(*keys, "name", F.when(share == 0, F.col("lower")).otherwise((1 - share) * F.col("lower") + share * upper).alias("_p"))
        out = mixed.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("_p"))).alias(name) for name in shares))
        return kept(out, "percentiles")[0]


def ranked_values(df: DataFrame, column: str, code: str) -> DataFrame:
    """(column, code): the distinct values that aren't null, numbered from 0 in their order.

    Values are dealt by range and counted by partition; what stands before a partition comes from that
    small table, and places within one from an order of the partition alone."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with intermediates(spark) as keep:
        values = keep(df.select(column).filter(F.col(column).isNotNull()).distinct(), "values")
        dealt = keep(values.repartitionByRange(parts, column).withColumn("_part", F.spark_partition_id()), "ranges")
        counts, total = sorted(dealt.groupBy("_part").count().collect()), 0  # a row for each partition
        before = []
        for part, many in counts:
            before.append((part, total))
            total += many
        offsets = spark.createDataFrame(before, "_part int, _before long")
        nth = F.row_number().over(Window.partitionBy("_part").orderBy(column))
        out = dealt.withColumn("_nth", nth).join(offsets, "_part")
        return kept(out.select(column, (F.col("_before") + F.col("_nth") - 1).alias(code)), "codes")[0]
