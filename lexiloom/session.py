"""A Spark session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",  # windows-1252 input
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # beyond this many rows a global top-K is a range-partitioned sort and limit
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def session(name: str = "lexiloom", **more: str) -> SparkSession:
    """The active session, or a new one; ``more`` adds settings."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()
