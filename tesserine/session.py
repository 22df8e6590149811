"""Session factory with the settings that the plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tesserine", master: str | None = None, **options: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in options.items()},
    }
    return builder.config(map=settings).getOrCreate()
