"""Streams run to the end of what is there, into a Parquet table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir, else the
    context's checkpoint folder); only a local master may go without either."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="lumispark-")
            atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
        base = _own[context.applicationId]
    return f"{base.rstrip('/')}/lumispark-{context.applicationId}/{tag}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a file or a folder, as a stream of its rows."""
    # a pattern that only the path itself matches: without one, the source takes it for a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def to_end(stream: DataFrame, tag: str) -> DataFrame:
    """Everything that the stream gives for what its source holds now, as a written table. The sink is
    exactly-once: state and output lie in the shared folder, so a lost executor costs a retry."""
    spark = stream.sparkSession
    path = shared_path(spark, tag)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state")
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
