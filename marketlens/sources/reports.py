"""Stored report tables, the report manifest, channels, and the Parquet sink.

The manifest has one row per uploaded report: `report_id, kind, name,
uploaded_at, status, stored, channel_id`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators.skew import lookup_join


def scan_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """Stored reports of different age together: columns by name, missing ones NULL."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def report_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema of tables written by `write_reports`; report ids stay text whatever they look like."""
    found = spark.read.option("mergeSchema", True).parquet(path).schema
    return T.StructType(
        [T.StructField(f.name, T.StringType()) if f.name == "report_id" else f for f in found.fields]
    )


def read_reports(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table written by `write_reports`."""
    return spark.read.schema(schema or report_schema(spark, path)).parquet(path)


def ready_reports(manifest: DataFrame, kind: str) -> DataFrame:
    """Reports of a kind that take part in queries."""
    return manifest.filter((F.col("kind") == kind) & (F.col("status") == "ready") & F.col("stored"))


def ready_ids(manifest: DataFrame, most: int) -> dict[str, list[str]] | None:
    """Ids of the reports that take part, by kind; None where there are more than `most`."""
    ready = manifest.filter((F.col("status") == "ready") & F.col("stored")).select("kind", "report_id")
    rows = ready.limit(most + 1).collect()
    if len(rows) > most:
        return None
    ids: dict[str, list[str]] = {}
    for row in rows:
        ids.setdefault(row.kind, []).append(row.report_id)
    return ids


def keep_ready(table: DataFrame, manifest: DataFrame, kind: str) -> DataFrame:
    return lookup_join(table, ready_reports(manifest, kind).select("report_id"), ["report_id"], "left_semi")


def record_outcomes(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The manifest after conversions: status, row count and error of every report that has an outcome.

    `outcomes` is what `report_status` returns. Other reports stay as they are, with no count or error.
    """
    found = outcomes.select("report_id", F.col("status").alias("_outcome"), "row_count", "error")
    joined = lookup_join(manifest, found, ["report_id"])
    outcome = F.col("_outcome")
    return joined.withColumns(
        {
            "status": F.coalesce(outcome, "status"),
            "stored": F.when(outcome.isNotNull(), outcome == "ready").otherwise(F.col("stored")),
        }
    ).drop("_outcome")


def remove_reports(table: DataFrame, removed: DataFrame) -> DataFrame:
    """The table without the removed reports."""
    return lookup_join(table, removed.select("report_id"), ["report_id"], "left_anti")


def report_channels(manifest: DataFrame, channels: DataFrame) -> DataFrame:
    """Channel name of every order report; '' where none or a deleted one is set."""
    named = channels.select(F.col("channel_id"), F.col("name").alias("sales_channel"))
    return (
        manifest.filter(F.col("kind") == "orders")
        .join(named, "channel_id", "left")
        .select("report_id", F.coalesce("sales_channel", F.lit("")).alias("sales_channel"))
    )


def list_reports(manifest: DataFrame, kind: str) -> DataFrame:
    """Reports of a kind, newest first."""
    return manifest.filter(F.col("kind") == kind).orderBy(F.col("uploaded_at").desc(), "report_id")


def list_channels(channels: DataFrame) -> DataFrame:
    return channels.orderBy("name")


def write_reports(table: DataFrame, path: str, dealt: bool = False) -> None:
    """Write whole reports; a report written before is replaced, others are left alone.

    The rebalance hint lets Spark size the files by data: a small report gets
    one file, a very large one is split over several tasks. Where a shuffle has
    `dealt` a large table already, every task writes its part of each report,
    and no wide line moves again. Order lines are sorted by date within a file,
    so a date range skips pages.
    """
    sized = table if dealt else table.hint("rebalance", "report_id")
    order = ["report_id", "order_ts"] if "order_ts" in table.columns else ["report_id"]
    (
        sized.sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("report_id")
        .parquet(path)
    )


def drop_stored(spark: SparkSession, path: str, report_ids: list[str]) -> None:
    """Remove the stored lines of reports that now convert to nothing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for report_id in report_ids:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(report_id)
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/report_id={name}")
        place.getFileSystem(conf).delete(place, True)
