"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries_images, queries_logs, queries_points, queries_tables  # noqa: F401  (importing registers)
from .queries_tables import fit_by_group
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return fit_by_group(spark, folder)


__all__ = ["QUERIES", "SQL", "flagship"]
