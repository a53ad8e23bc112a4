"""Token ids as ORC: one row per document, in ascending order of the document ids.

ORC keeps the ids as run-length encoded integers in stripes; every stripe and
row group carries smallest and largest values, and a Bloom filter of `doc_id`.
Spark reads stripes in parallel, and a filter on `doc_id` skips files, stripes
and row groups by these before any id is decoded.

Rows: doc_id, part (number of the file in id order), part_start (ids of the
file before the document), n_tokens, ids.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts
first; repeated doc_ids are written once per row, in any order among them; an
empty table gives a folder without rows; further columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import slices
from marketlens.llm.tokens import VOCABULARY, encoder

END_ID = 2
STRIPE_BYTES = 64 << 20
ROWS_PER_INDEX = 1000
BLOOM_FALSE_POSITIVES = 0.01

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Rows of the format, each partition a contiguous range of ids in ascending order."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = [enc.encode(text) + end for text in batch.column(1).to_pylist()]
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(start + offsets[:-1]),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
                ],
                ["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            start += int(offsets[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    (
        encode_documents(docs, vocabulary, end_id)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FALSE_POSITIVES))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(ROWS_PER_INDEX))
        .option("orc.create.index", "true")
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; `doc_ids` names the documents wanted, found through the stored indexes."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all documents before: a prefix sum over one row per file of `files`."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("before"))
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("part_start"))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column("ids")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            offsets = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("doc_id", "part", "part_start", "n_tokens")] + [pa.array(crc, pa.int64())],
                ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "part", "part_start", "n_tokens", "ids").mapInArrow(
        digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"
    )
