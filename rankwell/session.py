"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "rankwell", **overrides: str) -> SparkSession:
    """A session with adaptive execution on; pass master, memory and sizes through ``overrides``."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **overrides,
    }
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
