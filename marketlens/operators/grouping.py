"""Grouped detail: one aggregate list over any of ten keys, flat or as a tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import schemas as S
from marketlens.functions.money import exact_sum, shown_sum


def group_sums(row_count: str | None = None, summed: Callable[[Column], Column] = shown_sum) -> list[Column]:
    """Row count and the fourteen sums; sums of nothing are 0. `row_count` names the counts of rows that are sums already."""
    count = F.count(F.lit(1)) if row_count is None else F.sum(row_count)
    return [count.alias("row_count"), *[summed(F.col(c)).alias(c) for c in S.GROUP_SUMS]]


def grouped(lines: DataFrame, key: str) -> DataFrame:
    """Aggregates per value of a group key, as `group_value`."""
    return lines.groupBy(F.col(S.GROUP_KEYS[key]).alias("group_value")).agg(*group_sums())


def group_total(lines: DataFrame, key: str) -> DataFrame:
    """Number of groups for the pager; the NULL group does not count."""
    return lines.agg(F.count_distinct(F.col(S.GROUP_KEYS[key])).alias("total"))


def group_totals(lines: DataFrame, keys: list[str]) -> DataFrame:
    """`group_key, total` of several keys at once.

    Spark takes all distinct counts from one scan: each line gives one row per
    key, which are made distinct before anything is shuffled.
    """
    totals = lines.agg(*[F.count_distinct(F.col(S.GROUP_KEYS[k])).alias(k) for k in keys])
    pairs = F.array(*[F.struct(F.lit(k).alias("group_key"), F.col(k).alias("total")) for k in keys])
    return totals.select(F.inline(pairs))


def group_tree(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Every level of the nested grouping by `keys` at once.

    Sums add up, so lines are grouped once at the deepest level and the rollup
    runs on those groups. `depth` is the number of keys a row is grouped by;
    deeper key columns are NULL.
    """
    columns = [S.GROUP_KEYS[k] for k in keys]
    leaves = lines.groupBy(*columns).agg(*group_sums(summed=exact_sum))
    # grouping_id has one bit per rolled-up key, so depth n has n leading zeros.
    depth = F.lit(len(columns)) - F.bit_count(F.grouping_id())
    return (
        leaves.rollup(*columns)
        .agg(*group_sums("row_count"), depth.cast("int").alias("depth"))
        .filter(F.col("depth") > 0)
        .select("depth", *columns, "row_count", *S.GROUP_SUMS)
    )


def empty_groups(spark) -> DataFrame:
    """The page shown for an unknown group key."""
    fields = ["group_value string", "row_count bigint", *[f"{c} double" for c in S.GROUP_SUMS]]
    return spark.createDataFrame([], ", ".join(fields))
