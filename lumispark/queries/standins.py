"""Driver tables read as measurements: images of 8 x 8 pixels, tracks and object tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a track table: label = user, frame = day from 2024-01-01."""
    events = table(spark, sf_dir, "events")
    frame = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return events.select("event_id", F.col("user_id").alias("label"), frame.alias("frame"), "event_type", "value", "ts")


def pixels(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """embeddings as images: 64 values in rows of 8. apart: dealt by image before pixels are made of them,
    so that windows within an image move none."""
    vectors = table(spark, sf_dir, "embeddings")
    if apart:
        vectors = vectors.select("vec_id", "embedding").repartition("vec_id")
    long = vectors.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "value"))
    return long.select("image_id", F.expr("pos DIV 8").cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.col("value").cast("double").alias("v"))


#: The same in SQL, to stand before a query.
TRACKS = """trk AS (SELECT event_id, user_id AS label, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS frame, event_type, value, ts FROM events)"""
PIXELS = """pix AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
