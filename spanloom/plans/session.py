"""A session with the settings that the plans of this engine want."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans with skewed joins split, UTC, and Arrow for what goes to Python. Other settings are the cluster's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
