"""Session helper: only settings the library relies on, everything else is left to the cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "layerframe", cpus: int | None = None, shuffle: int | None = None) -> SparkSession:
    """Return the running session, or start one.

    On a cluster the master comes from spark-submit; ``cpus`` asks for a local one.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cpus:
        b = b.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    return b.getOrCreate()
