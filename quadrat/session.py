"""Session factory with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quadrat", master: str | None = None, time_zone: str = "UTC", **conf: str) -> SparkSession:
    """AQE with skew handling on, Arrow on, one fixed time zone. Cluster sizing is left to the caller's ``conf``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": time_zone,
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    return b.config(map=base | conf).getOrCreate()
