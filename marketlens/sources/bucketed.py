"""Order lines and fees stored by the order they are joined on.

Both tables are dealt by a hash of the order id into the same number of buckets
and sorted by it, so the one join whose sides both grow with the data reads
bucket against bucket: neither side is shuffled, however often it is asked for.
Lines without an order id, which may be a large part of a report, have no fee;
they are kept apart, in files of any size, and never meet the join.

The number of buckets is kept with the tables; the session knows them by a name
made from their folder.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators.enrich import fee_per_order

KEY = "order_id"
# Lines a bucket is meant to hold: sorted in one task.
BUCKET_LINES = 500_000


def write_by_order(lines: DataFrame, cashflow: DataFrame, root: str, buckets: int | None = None) -> None:
    """Store order lines and the fees of their orders below `root`, for `read_with_fees`."""
    spark = lines.sparkSession
    named = lines.filter(F.coalesce(F.col(KEY), F.lit("")) != "")
    buckets = buckets or max(1, -(-named.count() // BUCKET_LINES))
    lines.filter(F.coalesce(F.col(KEY), F.lit("")) == "").write.parquet(f"{root}/unnamed")
    for name, table in (("lines", named), ("fees", fee_per_order(cashflow))):
        known = _name(f"{root}/{name}")
        spark.sql(f"DROP TABLE IF EXISTS {known}")
        # One file per bucket: the rows are dealt as the buckets are.
        (
            table.repartition(buckets, KEY)
            .write.bucketBy(buckets, KEY)
            .sortBy(KEY)
            .format("parquet")
            .option("path", f"{root}/{name}")
            .saveAsTable(known)
        )
    layout = [(buckets, name, spark.table(_name(f"{root}/{name}")).schema.json()) for name in ("lines", "fees")]
    spark.createDataFrame(layout, "buckets int, name string, schema string").coalesce(1).write.parquet(f"{root}/layout")


def _name(folder: str) -> str:
    return f"by_order_{hashlib.md5(folder.encode()).hexdigest()}"


def _table(spark: SparkSession, folder: str, buckets: int, schema: str) -> DataFrame:
    """The stored table, made known to a session that has not written it."""
    name = _name(folder)
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(schema)).fields)
        spark.sql(
            f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )
    return spark.table(name)


def read_with_fees(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """`columns` of all lines and `order_aff_fee`, the fee of the line's order; 0 where it has none."""
    layout = {r.name: (r.buckets, r.schema) for r in spark.read.parquet(f"{root}/layout").collect()}
    lines, fees = (_table(spark, f"{root}/{name}", *layout[name]) for name in ("lines", "fees"))
    needed = list(dict.fromkeys([*columns, KEY]))
    joined = lines.select(*needed).join(fees.hint("merge"), KEY, "left")
    fee = F.coalesce("order_aff_fee", F.lit(0.0)).alias("order_aff_fee")
    unnamed = spark.read.parquet(f"{root}/unnamed").select(*columns, F.lit(0.0).alias("order_aff_fee"))
    return joined.select(*columns, fee).unionByName(unnamed)
