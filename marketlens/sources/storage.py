"""Where jobs may keep intermediate files."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder the session names in `spark.checkpoint.dir`.

    A folder of this machine is used only where the session names none and
    runs on this machine alone.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="marketlens-")


def kept(table: DataFrame, name: str) -> DataFrame:
    """A table written once to the shared folder and read from there: it is not computed again, and Spark knows its size."""
    place = f"{work_dir(table.sparkSession)}/{name}-{uuid.uuid4().hex}"
    table.write.option("compression", "zstd").parquet(place)
    return table.sparkSession.read.schema(table.schema).parquet(place)


def release(spark: SparkSession) -> None:
    """Have the driver collect the plans of finished steps: called between the steps of a job of many queries.

    Until then the driver's heap grows to its limit, and executors keep the shuffle and broadcast files of these steps.
    Python lets go first, as its objects hold the JVM's.
    """
    gc.collect()
    spark._jvm.System.gc()
