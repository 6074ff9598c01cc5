"""SimHash near-dedup with multi-index hashing.

A fingerprint has two segments of 32 bits, and every distinct fingerprint enters a table under each
of them. Two fingerprints that differ in at most two bits differ in at most one bit of some segment,
so each probes the tables with the radius-1 Hamming ball of each of its segments, and whole
distances are verified on the matches.

A table slot that many fingerprints share (copies that differ in one segment only) is hot: matching
it whole would meet all pairs of the slot. Its fingerprints and probes are filed under the radius-1
ball of the other segment as well: what is left of a distance of two is at most two bits there, and
two such balls meet in the middle. At most 33 fingerprints share such a key, so no key of either
join holds many rows, and every pair within two bits is still found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumispark.llm.components import components
from lumispark.llm.shared import keep_ids, scratch, text_of, written

SEED = 42
BITS, SEGMENT = 64, 32
#: Fingerprints that share a segment up to which they are matched by that segment alone.
HOT = 64


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of each word shingle in order, repeats included.

    bytes.lower() touches A-Z only and bytes.split() cuts at space and \\x09-\\x0D only, which is the
    contract's normalisation. Fewer words than a shingle: the whole sequence is the one shingle.
    """
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit majority of the shingles' hashes; 0 without words."""
    if not text.strip():
        return 0
    hashes = shingle_hashes(text, shingle)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _ball(value: Column) -> Column:
    """The 33 values of 32 bits at distance 0 or 1."""
    return F.array(value, *(value.bitwiseXOR(F.lit(1 << k)) for k in range(SEGMENT)))


def _segments(fp: Column) -> tuple[Column, Column]:
    """Low and high segment, as unsigned numbers."""
    return fp.bitwiseAND(F.lit((1 << SEGMENT) - 1)), F.shiftrightunsigned(fp, SEGMENT)


def fingerprint_links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (fp, other), fp < other, of all pairs at Hamming distance 1 or 2. fps: one column fp, distinct.

    A slot is a segment's value, the high segment's plus 2^32. hot: fingerprints of a slot from
    which on the other segment's ball is part of the key.
    """
    own, fp = F.lit(1 << SEGMENT), F.col("fp")
    low, high = _segments(fp)
    tables = fps.select("fp", F.explode(F.array(low, high + own)).alias("slot"))
    sizes = tables.groupBy("slot").agg(F.count(F.lit(1)).alias("many"))
    probes = fps.select("fp", F.explode(F.concat(_ball(low), F.transform(_ball(high), lambda v: v + own))).alias("slot"))
    alone = (F.col("many") == 1) & ((F.col("slot") == low) | (F.col("slot") == high + own))
    hits, _ = written(probes.join(sizes.hint("merge"), "slot").filter(~alone), "slot-hits")
    filed = tables.withColumnRenamed("fp", "other")
    pairs = hits.filter(F.col("many") <= hot).join(filed.hint("merge"), "slot").select("fp", "other")

    def balls(rows: DataFrame, name: str) -> DataFrame:
        first, second = _segments(F.col(name))
        return rows.select(name, "slot", F.explode(_ball(F.when(F.col("slot") < own, second).otherwise(first))).alias("middle"))

    crowded = hits.filter(F.col("many") > hot)
    in_crowd = filed.join(crowded.select("slot").distinct().hint("merge"), "slot", "left_semi")
    met = balls(crowded.select("fp", "slot"), "fp").join(balls(in_crowd, "other").hint("merge"), ["slot", "middle"]).select("fp", "other")
    near = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2)
    return pairs.filter(near).unionByName(met.filter(near)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of 2 or fewer differing bits, itself
    included; null if no row of the component has an id. Null and empty texts, and texts of white
    space, have fingerprint zero and link like any other. Very long texts are read whole, in blocks
    of shingles. A bit set in exactly half the hashes is 0. Repeated rows share their component. An
    empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        rows, path = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
        keep(path)
        nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
        roots, _ = written(components(fingerprint_links(nodes.select("fp")), "fp", "other"), "roots")
        # merged, as no table here is small enough for the driver whatever its files weigh; written, so that both sides of the joins are plain exchanges and a hot root or fingerprint can be split
        rooted, _ = written(nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
        least, _ = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        of, path = written(rooted.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component_id"), "components")
        keep(path)
    return rows.join(of.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs with the one document of each component that has the smallest id.

    Rows without an id stay, as no decision names them; rows that repeat the id kept all stay. Null,
    empty and very long texts as in near_duplicates. An empty table gives no rows.
    """
    found = near_duplicates(docs, id_col, text_col, shingle)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(id_col))
    return keep_ids(docs, kept, id_col)
