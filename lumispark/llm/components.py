"""Connected components of a link table by alternating star contraction.

Each round points every node at the smallest neighbour it knows, first among its larger neighbours,
then among its smaller ones; the rounds grow with the logarithm of the longest path. Every round is
two grouped minima and two joins by key, written to the shared folder, so a lost executor costs one
round at most and no link ever reaches the driver. The minima are written before they are joined:
both sides are then plain exchanges, and the many links of a hub can be split over tasks. Joins are
by merging: files of sorted ids are so much smaller than the ids that Spark would take minima of
millions of nodes for a table to broadcast, and the driver would hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispark.llm.shared import drop_path, written


def _to_larger(links: DataFrame, used: list[str]) -> DataFrame:
    """Each node's larger neighbours linked with the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    best, path = written(both.groupBy("high").agg(F.least(F.col("high"), F.min("low")).alias("_best")), "least-neighbours")
    used.append(path)
    return (
        both.filter(F.col("low") > F.col("high"))
        .join(best.hint("merge"), "high")
        .select(F.col("low").alias("high"), F.col("_best").alias("low"))
        .distinct()
    )


def _to_smaller(links: DataFrame, used: list[str]) -> DataFrame:
    """Each node and its smaller neighbours linked with the smallest of those."""
    best, path = written(links.groupBy("high").agg(F.min("low").alias("_best")), "least-neighbours")
    used.append(path)
    moved = links.join(best.hint("merge"), "high").filter(F.col("low") != F.col("_best")).select(F.col("low").alias("high"), F.col("_best").alias("low"))
    return moved.unionByName(best.select("high", F.col("_best").alias("low"))).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with a link to another: root is the smallest node it can reach.

    Self-links and repeated links change nothing; no links give no rows. Nodes are integers.
    """
    spark = links.sparkSession
    a, b = F.col(left), F.col(right)
    state, path = written(
        links.filter(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "links"
    )
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).alias("mark")
    before = state.agg(mark).first()[0]
    while before[0]:
        used = [path]
        larger, middle = written(_to_larger(state, used), "links")
        following, new = written(_to_smaller(larger, used), "links")
        after = following.agg(mark).first()[0]
        for done in (*used, middle):
            drop_path(spark, done)
        state, path = following, new
        if after == before:
            break
        before = after
    roots = state.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
