"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marketlens.sources.storage import work_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rows handled at once inside a task; bounds what a batch of texts expands to.
SLICE_ROWS = 256


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one all executors share (`spark.checkpoint.dir`)."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage with files that survive a lost executor. The shuffle
    files of the writing job are given back as soon as it has ended.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside pass at most so many rows at once to Python: batches of long rows take memory on both sides."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def by_position(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The same rows with columns c0, c1, ..., and the names these had: whatever they are, they clash with nothing."""
    return docs.toDF(*[f"c{n}" for n in range(len(docs.columns))]), docs.columns


def filtered(docs: DataFrame, keep: Callable[[pa.RecordBatch], Sequence[bool]]) -> DataFrame:
    """The rows that `keep` says True to, a batch of them at a time, with all their columns."""
    plain, names = by_position(docs)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(keep(batch.rename_columns(names)), pa.bool_()))

    return plain.mapInArrow(choose, plain.schema).toDF(*names)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
