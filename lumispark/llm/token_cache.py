"""Token counts with a digest cache.

Every text is named by the digest of its normalised content, every tokenizer by the digest of its
file. Stored counts are joined on both; of the texts without one, each distinct text is encoded once
and its count appended to the cache. Only one shuffle carries texts, at most one copy per map task;
the join back to single rows carries digests, on sides Spark can split when a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.llm.shared import shared_folder, text_of, written
from lumispark.llm.tokens import ids_function, tokenizer_digest

CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def default_cache(spark: SparkSession) -> str:
    """The cache of the shared folder; it outlives the application."""
    return f"{shared_folder(spark)}/lumispark-token-counts"


def stored_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """(content, n_tokens) stored for a tokenizer version; one row for each content."""
    if not _exists(spark, cache_path):
        return spark.createDataFrame([], "content binary, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache_path: str | None = None,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: no bytes, no tokens. normalise must leave counts as they are; by
    default it changes nothing. Runs that write to one cache at once may store a count twice, which
    changes no result. Very long texts are encoded whole. An empty table gives no rows; other columns
    are ignored; repeated rows each get their row, null ids too. Without cache_path the cache is the
    one of the shared folder, which all runs with that folder read and add to.
    """
    spark = docs.sparkSession
    path, version = cache_path or default_cache(spark), tokenizer_digest(tokenizer)
    text = normalise(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("content"))
    distinct = docs.select(F.unhex(F.sha2(text, 256)).alias("content"), text.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(stored_counts(spark, path, version), "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_function(tokenizer)
        for batch in batches:
            counts = [len(ids(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    fresh = misses.mapInArrow(encode, "content binary, n_tokens long")
    fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(path)
    # written, so that both sides of the join are plain exchanges and a hot content can be split
    counts, _ = written(stored_counts(spark, path, version), "token-counts")
    return rows.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
