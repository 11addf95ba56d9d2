"""Session builder with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "mnemolake", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings, dots written as double underscores."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
