"""Near-dedup by HyperMinHash: texts whose shingle sets overlap by a percentage or more.

Equal sets are one node, named by 128 bits. A node has BANDS * ROWS buckets: a shingle's hash names
its bucket, and the bucket keeps the least of the rest of the hash, compressed to how many zeros
lead it and the MANTISSA bits after the first one. A band of ROWS registers is a key; an empty
bucket borrows in it from another in an order fixed for each bucket, so small sets have whole keys
too. A pair of similarity s shares a key with probability 1 - (1 - s ** ROWS) ** BANDS: at 0.8 all
but one in ten million pairs do.

Of nodes with one key, each meets the NEIGHBOURS before it; where that leaves a key in several
components, the nodes outside the largest of them are held against all nodes of the key in other
ones, in blocks of bounded size: first only to take the best partner of each node, then, when those
have joined what is alike, to take every pair that is left. What their registers say, less the collisions that compressed
registers of different shingles have, leaves out pairs six standard deviations below the percentage;
so does the exact bound that bitmaps of the sets give. Pairs are verified on whole sets; of the first
sieve the best of each node, then those still in different components. Texts
move once, to write the sets of the nodes that share a key with another.

Sets so small that similar ones differ in one shingle at most are linked exactly, without registers:
one is the other less a shingle, so the names of those meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumispark.llm.components import components
from lumispark.llm.shared import keep_ids, scratch, text_of, written
from lumispark.llm.simhash import shingle_hashes

SHINGLE, PERCENT = 2, 80
BANDS, ROWS, MANTISSA = 40, 5, 10
BUCKETS, EMPTY = BANDS * ROWS, 0xFFFF
NEIGHBOURS = 2
#: Bits of a set's bitmap.
BITS = 4096
#: Nodes of a block outside the largest component of a crowded key, for how many of those a block of all its
#: nodes is as large, and nodes of a task in which each meets those before it.
BLOCK, WIDER, CHAIN = 256, 8, 4096
_BORROW = np.argsort(np.random.default_rng(1).random((BUCKETS, BUCKETS)), axis=1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingle hashes, rising; none for texts without words."""
    return np.unique(np.array(shingle_hashes(text, shingle) if text.strip() else [], np.uint64))


def name_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed registers; EMPTY where no shingle falls."""
    bucket = ((shingles >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)  # rises with the hash
    first = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    least = np.minimum.reduceat(shingles & np.uint64(0xFFFFFFFF), first) if len(first) else np.zeros(0, np.uint64)
    out = np.full(BUCKETS, EMPTY, np.uint16)
    out[bucket[first].astype(np.int64)] = compressed(least)
    return out


def compressed(values: np.ndarray) -> np.ndarray:
    """Values of 32 bits as leading zeros and the bits after the first one."""
    length = np.frexp(values.astype(np.float64))[1].astype(np.int64)  # bits without leading zeros
    rest = values.astype(np.int64) - (np.int64(1) << np.maximum(length - 1, 0)) * (length > 0)
    shift = length - 1 - MANTISSA
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0), rest << np.maximum(-shift, 0) * (length > 0))
    return ((32 - length) << MANTISSA | mantissa).astype(np.uint16)


def bitmap(shingles: np.ndarray) -> bytes:
    """BITS bits; a shingle sets the one that its hash names."""
    bits = np.zeros(BITS, np.uint8)
    bits[(shingles & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def can_reach(own: np.ndarray, other: np.ndarray, many: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """False where bitmaps (rows of 64-bit words) show that sets of those sizes don't have the percentage.

    A common shingle sets a common bit; at most as many common ones share a bit as the smaller number
    of shingles that share one with another of their own set."""
    slack = np.minimum(many - np.bitwise_count(own).sum(axis=-1, dtype=np.int64), others - np.bitwise_count(other).sum(axis=-1, dtype=np.int64))
    both = np.bitwise_count(own & other).sum(axis=-1, dtype=np.int64) + slack
    return 100 * both >= percent * (many + others - both)


def band_keys(own: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key of 64 bits for each band of so many registers, empty ones filled from others."""
    full = own != EMPTY
    filled = own if full.all() else own[_BORROW[np.arange(BUCKETS), np.argmax(full[_BORROW], axis=1)]] * ~full + own * full
    bands = np.ascontiguousarray(filled.astype("<u2")).reshape(-1, rows)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64)


@lru_cache(maxsize=4096)
def _collisions(a: int, b: int) -> float:
    """Share of buckets in which two sets without common shingles have equal registers, for sizes 2^(k/4)."""
    zeros, part = np.arange(33), 1 << MANTISSA
    width = np.where(zeros < 32, 2.0 ** -(zeros + 1), 2.0**-32)
    low = np.where(zeros < 32, width, 0.0)
    edges = (low[:, None] + width[:, None] * np.arange(part) / part).ravel()
    share = np.repeat(width / part, part)
    at = [(1 - edges / BUCKETS) ** n - (1 - (edges + share) / BUCKETS) ** n for n in (2 ** (a / 4), 2 ** (b / 4))]
    return float((at[0] * at[1]).sum())


def estimates(own: np.ndarray, other: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarities by registers (rows of BUCKETS), collisions taken off, and the buckets they rest on."""
    some = ((own != EMPTY) | (other != EMPTY)).sum(axis=1)
    same = ((own == other) & (own != EMPTY)).sum(axis=1)
    size = [np.rint(4 * np.log2(np.maximum(s, 1))).astype(int).tolist() for s in (sizes, others)]
    chance = BUCKETS * np.array([_collisions(a, b) for a, b in zip(*size)])
    some = np.maximum(some, 1)
    raw = same / some
    return np.maximum(raw - chance / some * (1 - raw), 0.0), some


def could_be(estimate: np.ndarray, some: np.ndarray, percent: int) -> np.ndarray:
    """False where a pair of the percentage gives so low an estimate in less than one case in 10^8."""
    s = percent / 100
    return estimate >= s - 6 * np.sqrt(s * (1 - s) / some)


def _small(percent: int) -> int:
    """Shingles of both sets together up to which similar sets differ in one at most."""
    return -(-200 // (100 - percent)) - 1 if percent < 100 else 0


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, band: int = ROWS) -> DataFrame:
    """(doc_id, text_key, name, many, registers, bits, keys, less): keys of sets that can have a similar one which
    differs in more than one shingle; less are the names of small sets without one shingle."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.cast("binary").alias("text"))
    small = _small(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, many, held, bits, keys, less = [], [], [], [], [], []
                for text in part.column("text"):
                    own = shingle_set(text.as_py(), shingle)
                    regs = registers(own)
                    names.append(name_of(own))
                    many.append(len(own))
                    held.append(regs.astype("<u2").tobytes())
                    bits.append(bitmap(own))
                    keys.append(band_keys(regs, band) if len(own) and len(own) >= small - 1 else [])
                    near = 1 < len(own) <= small and 100 * (len(own) - 1) >= percent * len(own)
                    less.append([name_of(np.delete(own, k)) for k in range(len(own))] if near else [])
                columns = [*part.columns[:2], pa.array(names, pa.binary()), pa.array(many, pa.int64()), pa.array(held, pa.binary()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(less, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "name", "many", "registers", "bits", "keys", "less"])

    return rows.mapInArrow(run, "doc_id long, text_key binary, name binary, many long, registers binary, bits binary, keys array<long>, less array<binary>")


def chained(by_key: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) next to each other among the nodes of a key whose sizes allow the percentage.

    by_key: node, many, key, part. The order is that of the nodes, so keys that the same nodes share give the same pairs."""
    over = Window.partitionBy("key", "part").orderBy("node")
    before = F.array_compact(F.array(*(F.lag(F.struct("node", "many"), k).over(over) for k in range(1, NEIGHBOURS + 1))))
    pairs = by_key.select("node", "many", before.alias("before")).select("node", "many", F.explode("before").alias("other"))
    fits = 100 * F.least("many", "other.many") >= percent * F.greatest("many", "other.many")
    return pairs.filter(fits).select(F.col("other.node").alias("a"), F.col("node").alias("b")).distinct()


def _matrix(held: list[bytes], kind: str = "<u2") -> np.ndarray:
    return np.frombuffer(b"".join(held), kind).reshape(len(held), -1)


def crowded(by_key: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root, minor, asks, one, two): the nodes of keys in several components, dealt into the blocks they meet in.

    minor: outside the largest component of the key; asks: here as one of those that meet the others. A block
    `one` has about BLOCK minor nodes that ask, a block `two` about WIDER times as many of all, and every `one`
    meets every `two`. A key of one component but for few nodes takes about a row a node. Keys whose nodes were
    all compared already, or lie in one component, are left."""
    rooted = by_key.join(roots.hint("merge"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted, _ = written(rooted, "rooted-keys")
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("key").agg(F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("main"))
    mixed = mixed.filter((F.col("size") > NEIGHBOURS + 1) & (F.col("size") > F.col("main.size")))
    blocks = lambda size, block: F.ceil(size / block).cast("int")
    mixed = mixed.select("key", F.col("main.root").alias("main"), blocks(F.col("size") - F.col("main.size"), BLOCK).alias("ones"), blocks(F.col("size"), BLOCK * WIDER).alias("twos"))
    crowd, _ = written(rooted.join(mixed.hint("merge"), "key").withColumn("minor", F.col("root") != F.col("main")), "mixed-keys")
    place = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    asks = crowd.filter("minor").select("key", "node", "root", "minor", F.lit(True).alias("asks"), place("ones").alias("one"), each("twos").alias("two"))
    asked = crowd.select("key", "node", "root", "minor", F.lit(False).alias("asks"), each("ones").alias("one"), place("twos").alias("two"))
    return asks.unionByName(asked)


def across(by_key: DataFrame, held: DataFrame, roots: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b, estimate) with a key in common that lie in different components and could be similar.

    best: of each node only the pair with the best estimate in a block. held: node, many, registers, bits."""
    met = crowded(by_key, roots).join(held.select("node", "many", "registers", "bits").hint("merge"), "node")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        node, root, many, minor, asks = (table.column(c).to_numpy() for c in ("node", "root", "many", "minor", "asks"))
        held, bits = _matrix(table.column("registers").to_pylist()), _matrix(table.column("bits").to_pylist(), "<u8")
        found: list[tuple[int, int, float]] = []
        right = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks).tolist():
            those = right[(root[right] != root[i]) & (~minor[right] | (node[right] > node[i]))]  # two minor nodes meet once
            those = those[100 * np.minimum(many[those], many[i]) >= percent * np.maximum(many[those], many[i])]
            those = those[can_reach(bits[i], bits[those], many[i], many[those], percent)]
            if len(those):
                value, some = estimates(held[i][None], held[those], np.full(len(those), many[i]), many[those])
                kept = could_be(value, some, percent)
                those, value = those[kept], value[kept]
                if best and len(those):
                    those, value = those[[value.argmax()]], value[[value.argmax()]]
                found += [(min(node[i], n), max(node[i], n), v) for n, v in zip(node[those].tolist(), value.tolist())]
        a, b, v = zip(*found) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "estimate": pa.array(v, pa.float64())})

    return met.groupBy("key", "one", "two").applyInArrow(meet, "a long, b long, estimate double").dropDuplicates(["a", "b"])


def sieved(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with their estimate, without those that can't be similar."""
    of = lambda side: held.select(F.col("node").alias(side), F.col("many").alias(f"many_{side}"), F.col("registers").alias(f"held_{side}"), F.col("bits").alias(f"bits_{side}")).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            if batch.num_rows:
                many = at["many_a"].to_numpy(), at["many_b"].to_numpy()
                value, some = estimates(_matrix(at["held_a"].to_pylist()), _matrix(at["held_b"].to_pylist()), *many)
                reach = can_reach(_matrix(at["bits_a"].to_pylist(), "<u8"), _matrix(at["bits_b"].to_pylist(), "<u8"), *many, percent)
                kept = pa.array(could_be(value, some, percent) & reach)
                yield pa.RecordBatch.from_arrays([at["a"].filter(kept), at["b"].filter(kept), pa.array(value).filter(kept)], ["a", "b", "estimate"])

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long, estimate double")


def shingle_sets(docs: DataFrame, nodes: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles): the whole sets of nodes (node, text_key)."""
    text, wanted = text_of(text_col), nodes.select("text_key", "node").hint("merge")
    texts = docs.select(F.unhex(F.md5(text)).alias("text_key"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), shingle).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    one = texts.groupBy("text_key").agg(F.min("text").alias("text")).join(wanted, "text_key").select("node", "text")
    return one.mapInArrow(run, "node long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. sets: node, shingles."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}")).hint("merge")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            alike = []
            for x, y in zip(at["of_a"], at["of_b"]):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = pa.array(alike, pa.bool_())
            yield pa.RecordBatch.from_arrays([at["a"].filter(kept), at["b"].filter(kept)], ["a", "b"])

    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(compare, "a long, b long")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes lie in different components."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return known.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def hyperminhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, band: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts are linked whose sets of word shingles have 100 * intersection >= percent * union; component_id
    is the smallest doc_id reachable, itself included, null if no row of the component has an id. kept:
    doc_id is component_id; a null id is kept where its component has no other. band: registers of a key,
    a divisor of BUCKETS; fewer find more pairs of low similarity to leave out again. Texts of fewer words than
    a shingle are one shingle; null texts and texts without words have none and are linked with nothing.
    Repeated rows and texts of one set share a component. Very long texts are read whole. An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        rows, path = written(signatures(docs, id_col, text_col, shingle, percent, band), "signatures")
        keep(path)
        some = rows.filter(F.col("many") > 0)
        one = some.groupBy("name").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), *(F.first(c).alias(c) for c in ("many", "keys", "less")))
        nodes, _ = written(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
        by_key = nodes.select("node", "many", F.explode("keys").alias("key"))
        sizes = by_key.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
        by_key, _ = written(by_key.join(sizes.hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CHAIN))), "shared-keys")
        shared, _ = written(nodes.select("node", "name", "text_key").join(by_key.select("node").distinct().hint("merge"), "node"), "shared-nodes")
        whole = some.groupBy("name").agg(*(F.first(c).alias(c) for c in ("many", "registers", "bits")))
        held, _ = written(whole.join(shared.select("name", "node").hint("merge"), "name").select("node", "many", "registers", "bits"), "held")
        sets, _ = written(shingle_sets(docs, shared, text_col, shingle), "shingle-sets")
        small = nodes.select("node", F.explode("less").alias("name")).join(nodes.select(F.col("node").alias("other"), "name"), "name")
        links, _ = written(small.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")), "links")
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)  # none known yet
        settled = False

        def joined(pairs: DataFrame, best_first: bool = False) -> None:
            """Add the similar ones of the pairs to the links and follow up with the components.

            best_first: the best pair of each node, then what still lies apart; else all pairs at once."""
            nonlocal links, roots, settled
            with scratch(spark) as hold:
                pairs, _ = written(pairs, "pairs")

                def add(asked: DataFrame) -> None:
                    nonlocal links, roots, settled
                    found, path = written(verified(asked, sets, percent), "links")
                    hold(path)
                    if settled and found.isEmpty():
                        return  # the components are as they were
                    links = links.unionByName(found)
                    roots, path = written(components(links, "a", "b"), "roots")
                    hold(path)
                    settled = True

                if not best_first:
                    if not pairs.isEmpty():
                        add(pairs)
                    return
                ends = pairs.select("estimate", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("end"))
                best = ends.groupBy("end.node").agg(F.max(F.struct("estimate", "end.other")).alias("best"))
                first, _ = written(best.select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b")).distinct(), "pairs")
                add(first)
                rest, _ = written(apart(pairs.join(first, ["a", "b"], "left_anti"), roots), "pairs")
                if not rest.isEmpty():
                    add(rest)

        joined(sieved(chained(by_key, percent), held, percent), True)
        joined(across(by_key, held, roots, percent, True))
        joined(across(by_key, held, roots, percent, False))
        rooted, _ = written(nodes.select("node", "name", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        least, _ = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        of, path = written(rooted.join(least, "root").select("name", "component_id"), "components")
        keep(path)
    found = some.select("doc_id", "many", "name").join(of, "name").select("doc_id", "many", "component_id")
    none = rows.filter(F.col("many") == 0).select("doc_id", "many", F.col("doc_id").alias("component_id"))
    return found.unionByName(none).select("doc_id", F.col("many").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_hyperminhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with the one document of each component that has the smallest id.

    Texts without words and rows without an id stay; rows that repeat the id kept all stay."""
    found = hyperminhash_duplicates(docs, id_col, text_col, shingle, percent)
    return keep_ids(docs, found.filter("kept").select(F.col("doc_id").alias(id_col)), id_col)
