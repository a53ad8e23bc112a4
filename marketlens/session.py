"""Session settings the plans here profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings only; they change plans, never results.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Wide lines make long generated methods; beyond this size the JVM would
    # interpret instead of compile them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
