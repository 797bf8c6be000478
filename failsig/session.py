"""Session settings the jobs count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # times are text in UTC
    "spark.sql.session.timeZone": "UTC",
    # measured sizes decide about broadcasts, and split what is skewed in the remaining joins
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a batch of whole logs on its way to a Python worker is bounded by bytes, not by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}


def session(name: str = "failsig") -> SparkSession:
    """A session with these settings; master, memory and ``spark.checkpoint.dir`` come from
    spark-submit."""
    builder = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
