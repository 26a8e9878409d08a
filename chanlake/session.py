"""Session construction with the settings every query of this package relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results or plans; sizes are left to the cluster.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, cores: int | None = None, app: str = "chanlake") -> SparkSession:
    """A session for local work; on a cluster the submitted session is reused as it is."""
    b = SparkSession.builder.appName(app)
    if master or cores:
        b = b.master(master or f"local[{cores}]")
    for k, v in CONF.items():
        b = b.config(k, v)
    if master is None or master.startswith("local"):
        b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.sql.shuffle.partitions", str(cores or os.cpu_count() or 8))
    return b.getOrCreate()
