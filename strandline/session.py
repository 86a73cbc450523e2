"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Local days are computed from UTC; AQE coalesces small partitions and splits skewed ones in joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS; the caller's own shuffle partitions and paths stay."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS, and conf (underscores for dots) on top."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
