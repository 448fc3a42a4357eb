"""A session with the settings that the package is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestone", **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, Arrow transfer, UTC. Sizes (partitions, memory) are the
    cluster's business and come from its configuration or ``conf`` (dots as double underscores)."""
    b = SparkSession.builder.appName(name)
    base = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
