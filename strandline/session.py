"""A session with the settings that the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "strandline", master: str | None = None, **conf) -> SparkSession:
    """Adaptive execution, skew joins and UTC; anything else by name=value, with _ for each dot."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
    } | {k.replace("_", "."): str(v) for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()
