"""Token counts of the documents in flat token files that have no index.

A flat file is nothing but unsigned 16-bit ids, each document ended by a
separator id. Writers cut the stream into files of `FILE_TOKENS` ids wherever
that falls, so that a document may run over several. The scan searches each
block for separators at once; what lies before a block's first and after its
last separator is stitched to its neighbours by a prefix scan over one small
row per block, by stream, never by the ids themselves.

Streams: a writing task's files in order form one stream, which ends with a
separator. A listing of the files of finished tasks makes leftovers of lost
executors harmless, and a listing of the documents names those found.

Defined cases: a null or empty text counts 1, its separator; a text that holds
the separator's name is ordinary text; repeated rows count each; an empty table
gives no rows; a null doc_id is carried; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import scratch, slices, stored
from marketlens.llm.tokens import VOCABULARY, encoder

SEPARATOR = 49407
FILE_TOKENS = 4 << 20
BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write flat files below `path`; returns the listing (kind, stream, number, name, doc_id) as a stored table.

    Rows of kind 'file' name a file and its place in its stream; rows of kind
    'doc' name the document at a place of the stream.
    """
    end = np.array([separator], "<u2").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        enc, stream, attempt = encoder(vocabulary, special_as_text=True), TaskContext.get().partitionId(), uuid.uuid4().hex
        rows: list[tuple] = []
        held, limit, files, place = bytearray(), 2 * file_tokens, 0, 0

        def flush(size: int) -> None:
            nonlocal files
            name = f"{stream:06d}-{attempt}-{files:08d}.bin"
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(held[:size]))
            del held[:size]
            rows.append(("file", stream, files, name, None))
            files += 1

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held += np.frombuffer(enc.encode(text), "<u4").astype("<u2").tobytes() + end
                rows.append(("doc", stream, place, None, doc_id))
                place += 1
            while len(held) >= limit:
                flush(limit)
            yield listing(rows)
            rows.clear()
        if held:
            flush(len(held))
            yield listing(rows)

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, LISTING), "flat-listing")


LISTING = "kind string, stream int, number long, name string, doc_id long"


def listing(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "stream", "number", "name", "doc_id"]
    )


def scan_blocks(files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block of a file (name, content): its length and the places of its separators."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                for number, at in enumerate(range(0, len(ids), block_tokens)):
                    block = ids[at : at + block_tokens]
                    ends = np.flatnonzero(block == separator)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()]), pa.array([number], pa.int64()), pa.array([len(block)], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                        ["name", "block", "size", "ends"],
                    )

    return files.select("name", "content").mapInArrow(scan, "name string, block long, size long, ends array<long>")


def count_tokens(blocks: DataFrame) -> DataFrame:
    """Documents found in blocks (stream, number, block, size, ends): stream, place, start, n_tokens, n_blocks.

    The prefix scan runs over the blocks of a stream: how many ids and how many
    separators came before, and how many ids the last open document has so far.
    """
    order = Window.partitionBy("stream").orderBy("number", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        blocks.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("found", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
        .withColumn("ordinal", F.row_number().over(order))
        .withColumn("last_end", F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1)))
        .withColumn("last_block", F.when(F.size("ends") > 0, F.col("ordinal")))
        .withColumn("open_from", F.coalesce(F.last("last_end", True).over(before) + 1, F.lit(0)))
        .withColumn("open_block", F.coalesce(F.last("last_block", True).over(before), F.lit(1)))
    )
    ends = summed.select("stream", "at", "found", "ordinal", "open_from", "open_block", "ends", F.posexplode("ends").alias("n", "end"))
    return ends.select(
        "stream",
        (F.col("found") + F.col("n")).alias("place"),
        F.when(F.col("n") == 0, F.col("open_from")).otherwise(F.col("at") + F.expr("ends[n - 1]") + 1).alias("start"),
        (F.col("at") + F.col("end")).alias("stop"),
        F.when(F.col("n") == 0, F.col("ordinal") - F.col("open_block") + 1).otherwise(F.lit(1)).cast("long").alias("n_blocks"),
    ).select("stream", "place", "start", (F.col("stop") - F.col("start") + 1).alias("n_tokens"), "n_blocks")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, file_tokens: int = FILE_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the documents as flat files, scan those, and name what was found: doc_id, stream, place, start, n_tokens, n_blocks."""
    spark = docs.sparkSession
    path = scratch(spark, "flat")
    known = write_flat(docs, path, vocabulary, separator, file_tokens)
    files = known.filter("kind = 'file'").select("name", "stream", "number")
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, stream int, place long, start long, n_tokens long, n_blocks long")
    content = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    )
    blocks = stored(scan_blocks(content, separator, block_tokens), "blocks").join(files, "name")
    named = known.filter("kind = 'doc'").select("stream", F.col("number").alias("place"), "doc_id")
    return count_tokens(blocks).join(named, ["stream", "place"]).select("doc_id", "stream", "place", "start", "n_tokens", "n_blocks")
