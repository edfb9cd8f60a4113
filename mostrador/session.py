"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: small sides become broadcast joins, skewed partitions are split even where
    # that costs a further shuffle, small partitions are merged.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Event times are turned into timestamps by streams; the zone must not move them.
    "spark.sql.session.timeZone": "UTC",
    # Streams that remember keys for ever keep them on disk, not in the executors' heaps.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """A session builder with these settings."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
