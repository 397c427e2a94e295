"""A session with the settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sonolith", **conf: str) -> SparkSession:
    """UTC timestamps, adaptive plans with skew handling; ``conf`` (dots as __) wins."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
