"""Session settings the reports are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffle partitions, turns a join into a broadcast
# only after the size of a side is known, and splits the partitions of hot keys
# - also where a later step would otherwise have kept the partitioning.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A filter made of the keys of one side of a join thins the other before its
    # shuffle. It never changes a result; the limit is what the side that the
    # filter is made from may hold, and the documents of a year are more than
    # Spark's 10 MB.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark
