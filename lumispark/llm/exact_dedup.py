"""Exact dedup: group by 128-bit content hash, compare bytes inside groups, keep one stable id.

The shuffle is pre-aggregated: each map task sends a text once, however many copies it read, so a
group of copies that holds a third of all rows arrives as one row per map task. Grouping by
(hash, text) compares whole texts byte by byte within a hash, so two texts that share a hash stay
apart. The way back to single rows joins digests only, never texts, on sides Spark can split when a
key is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumispark.llm.shared import text_of


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones. Of equal texts the row with the `keep` ("largest" or "smallest")
    id stays; a null id loses to any other, and of repeated rows (same id, same text) one is kept.
    An empty table gives no rows; other columns are ignored.
    """
    best = F.max if keep == "largest" else F.min
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")).withColumn("_hash", hash_fn(F.col("_text")))
    groups = (
        rows.groupBy("_hash", "_text")
        .agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
        .select("_hash", F.unhex(F.sha2("_text", 256)).alias("_sha"), "group_size", "keep_id")
    )
    again = Window.partitionBy("doc_id", "_sha").orderBy("_hash")
    members = rows.select("doc_id", "_hash", F.unhex(F.sha2("_text", 256)).alias("_sha")).withColumn("_nth", F.row_number().over(again))
    return members.join(groups, ["_hash", "_sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", hash_fn: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """docs with one whole row of each group of equal texts, chosen as in exact_duplicates.

    One shuffle: texts meet by (hash, text) and carry the best row of each map task with them.
    Columns and their order are those of docs.
    """
    pick = F.max_by if keep == "largest" else F.min_by
    last = F.lit(-(1 << 63) if keep == "largest" else (1 << 63) - 1)
    others = [c for c in docs.columns if c != text_col]
    text = text_of(text_col)
    best = docs.groupBy(hash_fn(text).alias("_hash"), text.alias("_text")).agg(
        pick(F.struct(*(F.col(c) for c in others), F.col(text_col).isNull().alias("_lumispark_null")), F.coalesce(F.col(id_col), last)).alias("_row")
    )
    back = {c: F.col("_row").getField(c) for c in others} | {text_col: F.when(~F.col("_row._lumispark_null"), F.col("_text"))}
    return best.select(*(back[c].alias(c) for c in docs.columns))
