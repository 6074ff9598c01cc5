"""Near copies: texts whose sets of word shingles have a Jaccard similarity of a bound or more.

Two texts of five-word similarity 0.8 differ in about 10 of 64 SimHash bits, too many for segment
tables, so candidates come from MinHash here: `BANDS` keys a text, each of `ROWS` minima. A pair of
similarity s shares a key with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9996 at 0.8.

Candidates come in two rounds, so that a group of many copies isn't met by all its pairs. First each
text of a key is compared with the `NEIGHBOURS` before it in an order of another minimum, which
chains most of a group into one component. Then, in keys of more texts than that reaches, all pairs
that still lie in different components are compared, so every pair with a key in common is either
compared or in one component already. A bitmap of each shingle set bounds from below in how many
shingles two texts differ, and spares most of those pairs their sets. Similarities are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumispark.llm.components import components
from lumispark.llm.shared import keep_ids, scratch, text_of, written
from lumispark.llm.simhash import SEED, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, NEIGHBOURS = 20, 5, 4
#: Longs in the bitmap of a shingle set.
LONGS = 16
#: Tasks over which the texts of a key are spread in the second round.
BLOCKS = 8
_TIMES, _PLUS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_TIMES |= np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingle hashes, rising; texts without words have the empty shingle."""
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of the shingles under as many permutations."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 1 << 11):
        least = np.minimum(least, (_TIMES * shingles[at : at + (1 << 11)] + _PLUS).min(axis=1))
    return least


def bitmap(shingles: np.ndarray) -> list[int]:
    """LONGS * 64 bits; a shingle sets the one that its hash names."""
    bits = np.zeros(LONGS * 64, np.uint8)
    bits[shingles % np.uint64(LONGS * 64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that what a task makes of a batch stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, node, many, keys, orders, bits): node is XXH64 of the text, many the size of its shingle set."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("node"), text_of(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            many, keys, orders, bits = [], [], [], []
            for text in part.column("text"):
                shingles = shingle_set(text.as_py(), shingle)
                least = signature(shingles)
                many.append(len(shingles))
                keys.append([_signed(xxhash.xxh64_intdigest(minima.tobytes(), k)) for k, minima in enumerate(least.reshape(BANDS, ROWS))])
                orders.append(least[[-1, 0]].view(np.int64).tolist())
                bits.append(bitmap(shingles))
            longs = pa.list_(pa.int64())
            columns = [*part.columns[:2], pa.array(many, pa.int64()), *(pa.array(c, longs) for c in (keys, orders, bits))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "many", "keys", "orders", "bits"])

    return rows.mapInArrow(run, "doc_id long, node long, many long, keys array<long>, orders array<long>, bits array<long>")


def neighbours(nodes: DataFrame) -> DataFrame:
    """(node, many, before): the NEIGHBOURS before each node of a key that others share, in the key's order."""
    by_key = nodes.select("node", "many", "orders", F.posexplode("keys").alias("band", "key"))
    by_key = by_key.select("node", "many", "key", F.col("orders")[F.col("band") % 2].alias("order"))
    over = Window.partitionBy("key").orderBy("order", "node")
    before = F.array_compact(F.array(*(F.lag(F.struct("node", "many"), k).over(over) for k in range(1, NEIGHBOURS + 1))))
    placed = by_key.select("node", "many", before.alias("before"), F.lead("node").over(over).alias("_after"))
    return placed.filter((F.size("before") > 0) | F.col("_after").isNotNull()).select("node", "many", "before")


def candidates(near: DataFrame, bound: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of neighbours whose sizes allow the bound."""
    pairs = near.select("node", "many", F.explode("before").alias("other"))
    fits = F.least("many", "other.many") >= F.greatest("many", "other.many") * (bound - 1e-9)
    return pairs.filter(fits).select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).distinct()


def across(nodes: DataFrame, roots: DataFrame, bound: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) that share a key of more than NEIGHBOURS + 1 nodes, lie in different components and
    whose sizes and bitmaps allow the bound.

    Keys that lie in one component are left before anything is paired. The texts of a key are spread
    over BLOCKS tasks, each of which meets all of the key. slack is how many shingles of a text share
    a bit with another of the same text.
    """
    by_key = nodes.select("node", F.explode("keys").alias("key")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_key, _ = written(by_key, "nodes-by-key")
    mixed = by_key.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = mixed.filter((F.col("size") > NEIGHBOURS + 1) & (F.col("low") != F.col("high"))).select("key")
    longs = [f"bits_{k}" for k in range(LONGS)]
    flat = nodes.select("node", "many", *(F.col("bits")[k].alias(c) for k, c in enumerate(longs)))
    slack = F.col("many") - sum((F.bit_count(c) for c in longs), F.lit(0))
    block = F.pmod(F.xxhash64("node"), F.lit(BLOCKS))
    crowd, _ = written(by_key.join(mixed, "key").join(flat.withColumn("slack", slack), "node").withColumn("block", block), "crowd")
    spread = int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = crowd.repartition(spread, "key", "block").alias("one")
    two = crowd.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long")))).repartition(spread, "key", "block").alias("two")
    same = (F.col("one.key") == F.col("two.key")) & (F.col("one.block") == F.col("two.block"))
    different = (F.col("one.node") < F.col("two.node")) & (F.col("one.root") != F.col("two.root"))
    # of the shingles of both, at most the common bits and what the smaller slack hides are the same
    common = sum((F.bit_count(F.col(f"one.{c}").bitwiseAND(F.col(f"two.{c}"))) for c in longs), F.lit(0))
    many = F.col("one.many") + F.col("two.many")
    fits = (common + F.least("one.slack", "two.slack")) * F.lit(1 + bound) >= many * F.lit(bound) - F.lit(1e-6)
    sizes = F.least("one.many", "two.many") >= F.greatest("one.many", "two.many") * F.lit(bound - 1e-9)
    return one.join(two, same & different & sizes & fits).select(F.col("one.node").alias("a"), F.col("two.node").alias("b")).distinct()


def shingle_sets(docs: DataFrame, asked: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(node, shingles): the whole sets of the asked nodes, written once."""
    texts = docs.select(F.xxhash64(text_of(text_col)).alias("node"), text_of(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    one = texts.join(asked.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    return written(one.mapInArrow(run, "node long, shingles array<long>"), "shingle-sets")[0]


def links(docs: DataFrame, pairs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, bound: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts' similarity is the bound or more."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return similar(pairs, shingle_sets(docs, asked, text_col, shingle), bound)


def similar(pairs: DataFrame, sets: DataFrame, bound: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose similarity is the bound or more. sets: node, shingles."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}")).hint("merge")
    both = F.size(F.array_intersect("of_a", "of_b"))
    alike = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("many"))
    return alike.filter(F.col("both") >= (F.col("many") - F.col("both")) * F.lit(bound - 1e-9)).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bound: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, component_id.

    component_id is the smallest doc_id reachable over links of the similarity or more, itself
    included; null if no row of the component has an id. Texts of fewer words than a shingle are one
    shingle; null and empty texts, and texts of white space, are copies of each other. Repeated rows
    share their component. An empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        rows, path = written(signatures(docs, id_col, text_col, shingle), "signatures")
        keep(path)
        nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.any_value(c).alias(c) for c in ("many", "keys", "orders", "bits")))
        near, _ = written(neighbours(nodes), "neighbours")
        # texts move once: both rounds ask for texts that share a key only
        sets = shingle_sets(docs, near.select("node").distinct(), text_col, shingle)
        pairs, _ = written(candidates(near, bound), "candidates")
        found, _ = written(similar(pairs, sets, bound), "near-links")
        roots, _ = written(components(found, "a", "b"), "roots")
        pairs, _ = written(across(nodes, roots, bound), "candidates")
        more, _ = written(similar(pairs, sets, bound), "near-links")
        if not more.isEmpty():
            roots, _ = written(components(found.unionByName(more), "a", "b"), "roots")
        rooted, _ = written(rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        least, _ = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        of, path = written(rooted.select("node", "root").join(least, "root").select("node", "component_id"), "components")
        keep(path)
    return rows.select("doc_id", "node").join(of, "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bound: float = SIMILARITY) -> DataFrame:
    """docs with the one document of each component that has the smallest id; rows without an id stay."""
    found = near_copies(docs, id_col, text_col, shingle, bound)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(id_col))
    return keep_ids(docs, kept, id_col)
