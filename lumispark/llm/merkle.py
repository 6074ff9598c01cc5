"""Merkle manifest of a table: a tree for each group, one over the groups, and a proof for each row.

Rows of a group stand in the order of an id and become leaves; every `fanout` consecutive nodes
become their digest until one node, the subroot, remains. The subroots, in the order of the groups,
become the root likewise. A row's proof is what its digest has to be joined with on the way up.

Places in the order come from range partitions: each partition numbers its own rows, and a small
table of counts by partition and group says how many stand before it, so no group has to fit a task.
Trees are reduced by superblocks: rows are dealt by (group, place div fanout^levels), a task
collapses `levels` levels of one block, and the roots of the blocks are reduced in the same way.
A round divides the nodes by fanout^levels (2,187), so a group of 10^10 rows takes three. The upper
proof of a block is then put behind the lower proofs of its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumispark.llm.shared import scratch, written

FANOUT, LEVELS = 3, 7
DIGEST = 32


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The leaf of a row: SHA-256 of its values in order, each `-` if null, else byte count, `:`, value."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def node_digest(below: Sequence[bytes]) -> bytes:
    """SHA-256 over the hex digits of the digests, in order."""
    return hashlib.sha256(b"".join(below).hex().encode()).digest()


def collapse(nodes: list[bytes], levels: int, fanout: int) -> tuple[list[bytes], bytes]:
    """The proofs of the nodes up to the one that is left after the levels, and that one."""
    siblings = []
    for _ in range(levels):
        runs = [nodes[at : at + fanout] for at in range(0, len(nodes), fanout)]
        siblings.append([b"".join(run[:k] + run[k + 1 :]) for run in runs for k in range(len(run))])
        nodes = [node_digest(run) for run in runs]
    proofs = [b""]
    for level in reversed(siblings):
        proofs = [own + proofs[k // fanout] for k, own in enumerate(level)]
    return proofs, nodes[0]


def height(many: int, fanout: int) -> int:
    """Levels of a tree over so many nodes."""
    levels = 0
    while many > 1:
        many, levels = -(-many // fanout), levels + 1
    return levels


def fold(digest: bytes, place: int, many: int, proof: bytes, fanout: int = FANOUT) -> tuple[bytes, bytes]:
    """The root that a node at a place among so many leads to, and what is left of the proof."""
    while many > 1:
        first = place - place % fanout
        run, own = min(fanout, many - first), place - first
        others = [proof[k * DIGEST : (k + 1) * DIGEST] for k in range(run - 1)]
        digest, proof = node_digest([*others[:own], digest, *others[own:]]), proof[(run - 1) * DIGEST :]
        place, many = place // fanout, -(-many // fanout)
    return digest, proof


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with place (from 0, in the order within the group) and many (rows of the group).

    Rows that are alike in group and order columns get different places in any order, and can lie in
    several partitions. Nulls come first. group has no nulls.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    ranged = spread.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    where = ranged.schema.names.index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for name in batch.column(where).to_pylist():
                last, at = (last, at + 1) if name == last else (name, 0)
                places.append(at)
            more = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_part", "_at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    own, _ = written(ranged.mapInArrow(number, f"{fields}, _part int, _at long"), "numbered")
    counts = own.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    of, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(of).alias("many"))
    counts, _ = written(counts, "counts")
    return own.join(counts, [group, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_at")).alias("place"), "many")


def _bound(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(group, place, proof, root) of nodes (group, place, many, digest)."""
    block = fanout**levels

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        many = int(rows["many"].iat[0])
        proofs, root = collapse(rows["digest"].tolist(), min(levels, height(many, fanout)), fanout)
        out = rows[["group", "place", "block"]].assign(many=-(-many // block), proof=proofs, digest=None)
        out.iat[0, out.columns.get_loc("digest")] = root
        return out

    dealt = nodes.select("group", "place", "many", "digest", F.expr(f"place DIV {block}").alias("block"))
    done = dealt.groupBy("group", "block").applyInPandas(reduce, "group string, place long, block long, many long, proof binary, digest binary")
    lower, _ = written(done, "superblocks")
    roots = lower.filter(F.col("digest").isNotNull()).select("group", F.col("block").alias("place"), "many", "digest")
    if (lower.agg(F.max("many")).first()[0] or 1) <= 1:  # every tree is one block
        return lower.drop("digest", "many").join(roots.select("group", F.col("digest").alias("root")), "group").drop("block")
    upper, _ = written(_bound(roots, fanout, levels).select("group", F.col("place").alias("block"), F.col("proof").alias("above"), "root"), "upper-proofs")
    return lower.join(upper, ["group", "block"]).select("group", "place", F.concat("proof", "above").alias("proof"), "root")


def merkle_manifest(rows: DataFrame, digest: Column, group: Column, order: Column, carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row: id (the order value), leaf, place and many in its group, group_place and groups,
    subroot, root, proof (sibling digests end to end, lowest level first), and the columns of carry.

    digest: the leaf, 32 bytes. Groups stand in the byte order of their names, a null group first;
    within a group rows ascend by the order value, nulls first, then by leaf, so repeated ids have a
    defined tree and equal rows can take either place. A lone leaf is its subroot, a lone subroot the
    root. Very long texts only matter to the leaf. An empty table gives no rows. Other columns are ignored.
    """
    carry = carry or {}
    with scratch(rows.sparkSession) as keep:
        name = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
        leaves, _ = written(rows.select(name.alias("group"), order.alias("id"), digest.alias("leaf"), *(c.alias(k) for k, c in carry.items())), "leaves")
        placed, _ = written(numbered(leaves, "group", ["id", "leaf"]), "placed")
        low, _ = written(_bound(placed.select("group", "place", "many", F.col("leaf").alias("digest")), fanout, levels), "lower")
        subroots, _ = written(low.filter(F.col("place") == 0).select(F.lit("").alias("all"), "group", F.col("root").alias("subroot")), "subroots")
        top = numbered(subroots, "all", ["group"])
        top, _ = written(top.select("group", "subroot", F.col("place").alias("group_place"), F.col("many").alias("groups")), "top")
        high = _bound(top.select(F.lit("").alias("group"), F.col("group_place").alias("place"), F.col("groups").alias("many"), F.col("subroot").alias("digest")), fanout, levels)
        high = high.select(F.col("place").alias("group_place"), F.col("proof").alias("above"), "root")
        by_group, _ = written(top.join(high, "group_place"), "groups")
        whole = placed.join(low.select("group", "place", "proof"), ["group", "place"]).join(by_group, "group")
        out, path = written(
            whole.select("id", "leaf", "place", "many", "group_place", "groups", "subroot", "root", F.concat("proof", "above").alias("proof"), *carry), "manifest"
        )
        keep(path)
    return out


def verified_manifest(manifest: DataFrame, presented: str, fanout: int = FANOUT) -> DataFrame:
    """Rows of a manifest: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    presented: the column with the digest of what is to be verified; folded_root is what it leads to
    with the proof of the row. proof_sha256 is over the hex digits of the proof, that of nothing for
    an empty one.
    """
    many = ["place", "many", "group_place", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
            roots, proofs = [], []
            for own, proof, place, rows, group, groups in zip(at["_own"], at["proof"], *(at[c] for c in many)):
                subroot, rest = fold(own, place, rows, proof, fanout)
                roots.append(fold(subroot, group, groups, rest, fanout)[0].hex())
                proofs.append(hashlib.sha256(proof.hex().encode()).hexdigest())
            hexed = [[d.hex() for d in at[c]] for c in ("leaf", "subroot", "root")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (*hexed, proofs, roots)), pa.array([a == b for a, b in zip(roots, hexed[2])])],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    kind = manifest.schema["id"].dataType.simpleString()
    rows = manifest.select("id", "leaf", "subroot", "root", "proof", F.col(presented).alias("_own"), *many)
    return rows.mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tamper_report(docs: DataFrame, share: int = 2) -> DataFrame:
    """The manifest of documents held against copies whose texts lost their line feeds.

    Copies of rows whose unsigned crc32 of the decimal doc_id is divisible by share are changed, null
    texts stay; a row without doc_id is never changed. Rows whose text has no line feed still verify.
    Nulls in any column count as `-` in the leaf; repeated rows are leaves of their own.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    columns = {c: F.col(c) for c in fields}
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % share == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    presented = leaf_digest([*(columns[c] for c in fields[:-1]), changed])
    manifest = merkle_manifest(docs, leaf_digest([columns[c] for c in fields]), F.col("source"), F.col("doc_id"), {"presented": presented})
    return verified_manifest(manifest, "presented")
