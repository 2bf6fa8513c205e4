"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "parlance", **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings stay as they are."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in more.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
