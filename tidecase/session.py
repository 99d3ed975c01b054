"""Session settings the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidecase", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with adaptive execution and skew handling on.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions`` high: adaptive
    execution merges small partitions again, it cannot cut a partition that holds one key.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # tables stored in sorted buckets are read without sorting them again
        "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
