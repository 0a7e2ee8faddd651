"""Sessions with the settings this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive re-planning splits skewed joins and merges small partitions; timestamps are UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tidepool", **settings: str) -> SparkSession:
    """The running session, or a new one; ``settings`` use __ for dots."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
