"""Watershed as a minimum spanning forest, by rounds of grouped minima.

Pixels that share a face are joined by an edge as high as the higher of the two. Every basin is the
tree of a seed in the minimum spanning forest of these edges; edges of one height go by the place of
their first pixel, then by axis, so the forest is unique. In a round each tree without a seed takes
its lowest edge to another tree; trees that meet become one, trees with a seed only receive, and
edges inside a tree or between two seeds go. The trees without a seed at least halve each round, and
no image has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispark.operators.rounds import Keep, intermediates, kept, roots_of


def _edges(nodes: DataFrame, keys: list[str], axes: list[str], height: str) -> DataFrame:
    """(a, b, cost, seeded_a, seeded_b): pixels that share a face, but for two with seeds; cost orders the edges of an image without ties.

    nodes say whether they are seeded, so that no edge is moved to find out."""
    steps = F.array(*(F.struct(F.lit(k).alias("axis"), *((F.col(c) + int(c == a)).cast("int").alias(c) for c in axes)) for k, a in enumerate(axes)))
    here = nodes.select(*keys, F.struct(*axes).alias("_at"), F.col("node").alias("a"), F.col("seeded").alias("seeded_a"), F.col(height).alias("_h"), F.explode(steps).alias("_s"))
    here = here.select(*keys, "_at", "a", "seeded_a", "_h", F.col("_s.axis").alias("axis"), *(F.col(f"_s.{c}").alias(c) for c in axes))
    there = nodes.select(*keys, *(F.col(c).cast("int").alias(c) for c in axes), F.col("node").alias("b"), F.col("seeded").alias("seeded_b"), F.col(height).alias("_g"))
    met = here.join(there, [*keys, *axes]).filter("NOT (seeded_a AND seeded_b)")
    return met.select("a", "b", F.struct(F.greatest("_h", "_g").alias("top"), "_at", "axis").alias("cost"), "seeded_a", "seeded_b")


def _contracted(edges: DataFrame) -> DataFrame:
    """The lowest edge between each two trees, without those inside a tree or between two seeds.

    edges: a, b, cost, and whether a and b have seeds."""
    open_ = edges.filter("a <> b AND NOT (seeded_a AND seeded_b)")
    low, turned = F.least("a", "b"), F.col("a") > F.col("b")
    pairs = open_.select(low.alias("a"), F.greatest("a", "b").alias("b"), "cost", F.when(turned, F.col("seeded_b")).otherwise(F.col("seeded_a")).alias("seeded_a"), F.when(turned, F.col("seeded_a")).otherwise(F.col("seeded_b")).alias("seeded_b"))
    return pairs.groupBy("a", "b").agg(F.min("cost").alias("cost"), F.first("seeded_a").alias("seeded_a"), F.first("seeded_b").alias("seeded_b"))


def _forest(edges: DataFrame, seeds: DataFrame, keep: Keep) -> DataFrame:
    """(node, root) of the nodes that trees took up. seeds: node of each pixel with a seed; edges: one for each two pixels, kept."""
    marked, now = seeds.select(F.col("node").alias("root"), F.lit(True).alias("_seeded")), edges
    known = now.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    while now.limit(1).count():
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to"), F.col("seeded_a").alias("seeded")), F.struct(F.col("b").alias("node"), F.col("a").alias("to"), F.col("seeded_b").alias("seeded")))).alias("e"), "cost")
        taken = ends.filter("NOT e.seeded").groupBy(F.col("e.node").alias("node")).agg(F.min_by("e.to", "cost").alias("parent"))
        taken = keep(taken, "taken")
        # two trees that took the same edge: the smaller is the root
        back = taken.select(F.col("node").alias("parent"), F.col("parent").alias("_back"))
        tree = taken.join(back, "parent", "left").filter(~((F.col("_back") == F.col("node")) & (F.col("node") < F.col("parent"))) | F.col("_back").isNull())
        flat = roots_of(tree.select("node", "parent"), keep)
        up = flat.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        known = keep(known.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")).unionByName(flat), "roots")
        # a tree that took an edge has the seed of its new root or none; others have what they had
        grown = keep(flat.join(marked, "root", "left").select("node", "root", F.coalesce("_seeded", F.lit(False)).alias("seeded")), "grown")
        moved = lambda side: grown.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"), F.col("seeded").alias(f"_seeded_{side}"))  # noqa: E731, B023
        rooted = now.join(moved("a"), "a", "left").join(moved("b"), "b", "left")
        now = keep(_contracted(rooted.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "cost", *(F.coalesce(f"_{c}", c).alias(c) for c in ("seeded_a", "seeded_b")))), "edges")
    return known


def watershed(pixels: DataFrame, keys: list[str], axes: list[str], height: str, seed: str) -> DataFrame:
    """(keys, axes, label): pixels flooded from the seeds (labels above 0) from low to high, over faces.

    Pixels without a row are outside the mask and nothing flows over them; label is 0 where no seed
    reaches, and where the height is null. Pixels of one seed need not touch. Edges of one height go
    by the coordinates of their lower pixel, in the order of the axes, then by axis. No line is left
    between basins."""
    with intermediates(pixels.sparkSession) as keep:
        rows = pixels.select(*keys, *axes, F.col(height).alias("_height"), F.when(F.col(seed) > 0, F.col(seed)).alias("_seed"))
        nodes = keep(rows.withColumns({"node": F.monotonically_increasing_id(), "seeded": F.col("_seed").isNotNull()}), "nodes")
        seeds = nodes.filter(F.col("_seed").isNotNull()).select("node", "_seed")
        forest = _forest(keep(_edges(nodes.filter(F.col("_height").isNotNull()), keys, axes, "_height"), "faces"), seeds, keep)
        rooted = nodes.join(forest, "node", "left").select(*keys, *axes, F.coalesce("root", "node").alias("root"))
        named = rooted.join(seeds.select(F.col("node").alias("root"), F.col("_seed").alias("label")), "root", "left")
        return kept(named.select(*keys, *axes, F.coalesce("label", F.lit(0)).cast("int").alias("label")), "basins")[0]
