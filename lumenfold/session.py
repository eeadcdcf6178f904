"""A session with the settings that the results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lumenfold", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; partitions and memory are the cluster's business."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}.items() | conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
