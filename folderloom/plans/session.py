"""Session settings that these jobs are tuned for; all are plain Spark configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods over 8000 bytes of bytecode. Cleaning many columns in one
    # projection makes larger ones; beyond the limit Spark splits the projection instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
