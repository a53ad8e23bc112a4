"""Equi-joins that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when Spark estimates it below this many bytes. The estimate is of compressed files, of which a
# row may take 2 or 3 bytes; the driver, and every executor, holds it in 80 to 140: 1 MB of files becomes up to 50 MB.
BROADCAST_MAX_BYTES = 1024 * 1024
# A key with more rows than this is spread over SPREAD partitions. At most
# rows / HOT_ROWS keys can pass the mark, which bounds the broadcast key list.
HOT_ROWS = 1_000_000
SPREAD = 64
# Keys a sketch keeps of a report: each key with more than a 3,000th of the
# rows is among them, however many reports are merged, and no list is longer.
SKETCH_KEYS = 4096
# Columns that tell the rows of a table apart, where it has them.
ROW_KEY = ["report_id", "line_no"]


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a plan (joins are overestimated, so it errs on the safe side)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, max_bytes: int | None = None) -> bool:
    return estimated_bytes(df) <= (BROADCAST_MAX_BYTES if max_bytes is None else max_bytes)


def hot_keys(df: DataFrame, on: list[str], hot_rows: int | None = None) -> DataFrame:
    """Keys held by more than `hot_rows` rows; reads the key columns only and combines before the shuffle."""
    mark = HOT_ROWS if hot_rows is None else hot_rows
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > mark).select(*on)


def key_sketches(df: DataFrame, keys: dict[str, Column], by: list[str]) -> DataFrame:
    """One row per group of `by` with a sketch of the most frequent values of each key, to be stored with the rows."""
    named = df.select(*by, *[c.cast("string").alias(name) for name, c in keys.items()])
    return named.groupBy(*by).agg(*[F.expr(f"approx_top_k_accumulate(`{name}`, {SKETCH_KEYS})").alias(name) for name in keys])


def sketched_keys(sketches: DataFrame, name: str, hot_rows: int | None = None) -> DataFrame:
    """Keys of stored sketches that hold more than `hot_rows` rows together: at most SKETCH_KEYS rows, without reading a line."""
    mark = HOT_ROWS if hot_rows is None else hot_rows
    merged = f"approx_top_k_estimate(approx_top_k_combine(`{name}`, {SKETCH_KEYS}), {SKETCH_KEYS})"
    found = sketches.agg(F.expr(merged).alias("found")).select(F.explode("found").alias("f"))
    return found.filter(F.col("f.count") > mark).select(F.col("f.item").alias(name))


def frequent_keys(df: DataFrame, column: str) -> DataFrame:
    """Values of a column that more than HOT_ROWS rows hold, by one sketch: the column is read, but not shuffled."""
    found = sketched_keys(key_sketches(df, {column: F.col(column)}, []), column)
    return found.filter(F.col(column).isNotNull()).select(F.col(column).cast(df.schema[column].dataType).alias(column))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    hot: Callable[[], DataFrame] | None = None,
    size_of: DataFrame | None = None,
) -> DataFrame:
    """Join `right` to the (usually much larger) `left` on equal keys.

    A right side of checked small size is broadcast and nothing is shuffled.
    Otherwise both sides are shuffled on the key; rows of hot keys get a salt
    computed from the row itself, so a re-run task puts them in the same place,
    and the matching right rows are repeated once per salt. `hot` may name a
    cheaper way to the hot keys than counting the rows of `left`, `size_of` a
    table that `right` cannot outgrow, where Spark overestimates `right` itself.
    """
    if small(right if size_of is None else size_of):
        return left.join(F.broadcast(right), on, how)
    keys = hot_keys(left, on) if hot is None else hot()
    flagged = F.broadcast(keys.select(*on, F.lit(True).alias("_hot")))
    missing_key = F.lit(False)
    for name in on:
        missing_key = missing_key | F.col(name).isNull()
    # The row key alone where there is one, so that no other column is kept for the salt.
    told_by = ROW_KEY if set(ROW_KEY) <= set(left.columns) else left.columns
    salt = F.pmod(F.xxhash64(*told_by), F.lit(SPREAD)).cast("int")
    salted_left = left.join(flagged, on, "left").withColumn(
        "_salt", F.when(F.col("_hot") | missing_key, salt).otherwise(F.lit(0))
    )
    every_salt = F.sequence(F.lit(0), F.lit(SPREAD - 1))
    salted_right = right.join(flagged, on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every_salt).otherwise(F.array(F.lit(0))))
    )
    joined = salted_left.drop("_hot").join(salted_right.drop("_hot"), [*on, "_salt"], how)
    return joined.drop("_salt")
