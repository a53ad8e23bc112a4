"""Sorting, paging and export."""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens import schemas as S

PAGE_SIZE = 15


def sort_columns(column: str, direction: str, ties: list[str]) -> list[Column]:
    """Sort by a column with NULLs last both ways; equal values in a fixed order."""
    descending = str(direction).lower() == "desc"
    main = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return [main, *[F.col(t).asc_nulls_last() for t in ties if t != column]]


def detail_order(sort: str = "order_ts", direction: str = "asc") -> list[Column]:
    """Order of detail lines; an unknown sort column falls back to the date."""
    column = sort if sort in S.DETAIL_SORT_COLUMNS else "order_ts"
    return sort_columns(column, direction, S.LINE_KEY)


def group_order(sort: str | None = "gross_sales", direction: str = "desc") -> list[Column]:
    column = sort if sort in S.GROUP_SORT_COLUMNS else "gross_sales"
    return sort_columns(column, direction, ["group_value"])


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page (numbered from 1) of `df` in the given order, as a top-k.

    Every task keeps the rows up to the page's end. To browse on from a page
    use `rows_after`; to jump far back use `write_numbered` and `stored_page`.
    """
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def rows_after(df: DataFrame, column: str, direction: str, ties: list[str], last: Mapping, size: int = PAGE_SIZE) -> DataFrame:
    """The rows that follow `last` in the order of `sort_columns`; every task keeps one page.

    `last` holds the values of the sort column and the ties, which together
    name one row.
    """
    keys = [column, *[t for t in ties if t != column]]
    same, following = F.lit(True), F.lit(False)
    for key in keys:
        value = last[key]
        if isinstance(value, (datetime.datetime, datetime.date)):
            value = str(value)
        value = F.lit(value).cast(df.schema[key].dataType)
        down = key == column and str(direction).lower() == "desc"
        further = (F.col(key) < value) if down else (F.col(key) > value)
        if last[key] is not None:  # nothing follows a NULL but its ties
            following = following | (same & (further | F.col(key).isNull()))
        same = same & F.col(key).eqNullSafe(value)
    return df.filter(following).orderBy(*sort_columns(column, direction, ties)).limit(size)


def write_numbered(df: DataFrame, order: list[Column], path: str) -> None:
    """Write `df` range-sorted, each row with its place inside its partition.

    The written copy keeps place and count consistent when a task is run
    again. All pages of one query read it; who wrote it deletes it.
    """
    part_bits = 33  # layout of monotonically_increasing_id: partition above, place below
    place = F.monotonically_increasing_id()
    (
        df.orderBy(*order)
        .withColumn("_id", place)
        .withColumn("_part", F.shiftright("_id", part_bits).cast("int"))
        .withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << part_bits) - 1)))
        .drop("_id")
        .write.parquet(path)
    )


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `write_numbered` with `row_number` from 0, without pulling them through one task."""
    stored = spark.read.parquet(path)
    # One row per sorted partition: bounded by the partition count, not by the data.
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return (
        stored.join(F.broadcast(starts), "_part")
        .withColumn("row_number", F.col("_start") + F.col("_place"))
        .drop("_part", "_place", "_start")
    )


def stored_page(spark: SparkSession, path: str, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page (numbered from 1) of a written copy, in its order."""
    offset = (max(1, number) - 1) * size
    at = F.col("row_number")
    wanted = numbered(spark, path).filter((at >= offset) & (at < offset + size))
    return wanted.orderBy("row_number").drop("row_number")


def page_count(total: int, size: int = PAGE_SIZE) -> int:
    """Number of pages shown by the pager, at least one."""
    return max(1, -(-total // size))


# ---------------------------------------------------------------------------
# Export
# ---------------------------------------------------------------------------


def relabel(df: DataFrame, columns: list[str], group_key: str | None = None) -> DataFrame:
    """Known columns in the asked order under their display labels."""
    if group_key is None:
        known = {c: S.DETAIL_LABELS[c] for c in S.DETAIL_COLUMNS}
    else:
        known = {c: S.DETAIL_LABELS[c] for c in S.GROUP_SUMS}
        known["row_count"] = S.ROW_COUNT_LABEL
        known["group_value"] = S.GROUP_LABELS[group_key]
    kept = [c for c in columns if c in known]
    if not kept:
        raise ValueError("no valid column to export")
    return df.select(*[F.col(c).alias(known[c]) for c in kept])


def write_export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write an export as a folder of part files in order; nothing passes the driver."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")
    writer.save(path)
