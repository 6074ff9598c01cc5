"""Named queries over the driver tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumispark.queries import files, images, kernels, measurements, shapes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return measurements.QUERIES | images.QUERIES | kernels.QUERIES | shapes.QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    return measurements.ORACLES | images.ORACLES | kernels.ORACLES | shapes.ORACLES | files.ORACLES
