"""Work in rounds: written intermediates, and connected components by hooking and jumping.

Joins on nodes are by merging: files of ids are far smaller than the ids, so by their size Spark would
broadcast tables of millions of nodes, and the driver would hold them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.streaming.runs import shared_path

Keep = Callable[[DataFrame, str], DataFrame]


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def kept(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written once in the shared folder and read back: no lineage, so a lost executor costs this step only."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[Keep]:
    """A function that keeps a table until the end of the block."""
    paths: list[str] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out, path = kept(df, tag)
        paths.append(path)
        return out

    try:
        yield keep
    finally:
        for path in paths:
            drop_path(spark, path)


def roots_of(parents: DataFrame, keep: Keep) -> DataFrame:
    """(node, root) of a forest (node, parent): each step doubles how far a node has looked up.

    Nodes without a parent are roots and have no row."""
    state = keep(parents.select("node", F.col("parent").alias("root")), "jump")
    while True:
        up = state.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        moved = state.join(up.hint("merge"), "root", "left")
        if not moved.filter(F.col("_up").isNotNull()).limit(1).count():
            return state
        state = keep(moved.select("node", F.coalesce("_up", "root").alias("root")), "jump")


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b) that isn't the smallest of its component: root is that one.

    In a round each root with a smaller neighbour hooks to the smallest, the trees that this makes are
    flattened, and links inside a tree go; only roots with larger neighbours alone are left. Sums and
    joins are by node; links shrink with each round. The table is kept in the shared folder."""
    spark = links.sparkSession
    with intermediates(spark) as keep:
        now = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
        known = now.select(F.col("high").alias("node"), F.col("low").alias("root")).limit(0)
        while now.limit(1).count():
            flat = roots_of(now.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent")), keep)
            moved = known.join(flat.select(F.col("node").alias("root"), F.col("root").alias("_up")).hint("merge"), "root", "left")
            known = keep(moved.select("node", F.coalesce("_up", "root").alias("root")).unionByName(flat), "roots")
            of = lambda side: flat.select(F.col("node").alias(side), F.col("root").alias(f"_{side}")).hint("merge")  # noqa: E731, B023
            ends = now.join(of("high"), "high", "left").join(of("low"), "low", "left").select(F.coalesce("_high", "high").alias("a"), F.coalesce("_low", "low").alias("b"))
            now = keep(ends.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
        return kept(known, "components")[0]
