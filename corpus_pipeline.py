"""The corpus pipeline: documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
back as the next stage's docs. All but the last return the columns of documents; n_chars follows the
text where a stage shortens it. Null columns, empty tables and repeated rows are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.llm.components import components
from lumispark.llm.exact_dedup import drop_exact_duplicates
from lumispark.llm.near_copies import near_copies
from lumispark.llm.packing import pack
from lumispark.llm.shared import drop_path, scratch, written
from lumispark.llm.simhash import near_duplicates
from lumispark.llm.suffix_repeats import drop_repeats
from lumispark.llm.toxicity import drop_toxic, fit_on_labels


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't call toxic.

    Null and empty texts score like texts without words; repeated rows stay or go together; texts are
    scored whole. Without labels of both classes nothing is known to be toxic. An empty table stays empty."""
    return drop_toxic(docs, fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id; of repeated rows one.

    Null texts equal empty ones; a null id loses to any other. An empty table stays empty."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Near copies are texts whose SimHash fingerprints differ in 2 bits or fewer, and those of five-word
    similarity of 0.8 or more, most of which lie further apart; groups follow links of both kinds. Null
    and empty texts are copies of each other; rows without an id, and those that share one, stay. An
    empty table stays empty."""
    with scratch(spark) as keep:
        found = near_duplicates(docs).select("doc_id", "component_id").unionByName(near_copies(docs).select("doc_id", "component_id"))
        links, _ = written(found.filter("doc_id <> component_id").distinct(), "near-links")
        roots, _ = written(components(links, "doc_id", "component_id").filter("node <> root"), "near-roots")
        once = docs.groupBy("doc_id").count().filter("count = 1")
        dropped, path = written(once.join(roots.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select("doc_id"), "near-dropped")
        keep(path)
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that stand anywhere else.

    Every row stays; null texts stay null, and texts that are repeats from end to end become empty.
    n_chars, where there is one, follows the text."""
    cut = drop_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece, as the packing operator gives them.

    Null and empty texts are one piece of the end id; an empty table gives no rows."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: A fitted classifier and a tokenizer aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage wrote for itself goes
            docs, path = written(stage(spark, docs, sf_dir), name)
            keep(path)
        if before:
            drop_path(spark, before)  # only the latest stage is read again
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
