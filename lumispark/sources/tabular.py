"""Measurement tables as files: explicit schemas, one canonical name for each column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispark.functions.classify import stem
from lumispark.sources.images import base_name

#: Names that other tools give to our columns, in lower case.
ALIASES = {"image": "filename", "vol_um": "vol_um", "roundness": "roundness", "unnamed: 0": "frame"}

SCHEMAS = {
    "cell_brightness": "identifier string, frame int, label int, area bigint, amount_av double, amount_pi double, mean_av double, mean_pi double",
    "death_curve": "identifier string, frame int, number_av bigint, number_pi bigint, number_of_long_tracks bigint",
    "acinus": "filename string, vol_um double, roundness double, flag string, well int, day int, condition string, treatment string, image_type string",
    "nucleus_cell": "filename string, nucleus_label int, cell_label int, nucleus_cell_volume_ratio double, nucleus_volume_um double, cell_volume_um double, cell_roundness double, nucleus_roundness double, sum int, external int, internal int",
    "radial_profile": "filename string, rounded_distance double, bm_intensity double, flag string, well int, day int, condition string, image_type string",
    "bf_acinus": "filename string, label int, area bigint, eccentricity double, area_um double, segmentation_type string, cell_type string, stiffness string, day int, day_status string",
}


def canonical(df: DataFrame) -> DataFrame:
    """Columns under their canonical names, whatever their case."""
    return df.select(*(F.col(f"`{c}`").alias(ALIASES.get(c.lower(), c.lower())) for c in df.columns))


def read_csv(spark: SparkSession, path: str, kind: str, pattern: str = "*.csv", recursive: bool = False) -> DataFrame:
    """All CSV files below a folder as one table of a known kind, with the name of each row's file.

    Columns go by their header names, in any order; ones that a file lacks are null; text that isn't
    a number is null."""
    reader = spark.read.option("header", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    found = canonical(reader.csv(path).withColumn("source_file", base_name(F.col("_metadata.file_path"))))
    wanted = [w.strip().split(" ") for w in SCHEMAS[kind].split(",")]
    columns = [(F.col(n).try_cast(t) if n in found.columns else F.lit(None).cast(t)).alias(n) for n, t in wanted]
    return found.select(*columns, stem(F.col("source_file")).alias("source_file"))


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return canonical(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
