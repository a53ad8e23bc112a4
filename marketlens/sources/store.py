"""Reports of all kinds in versions, behind one snapshot that is swapped in one step.

Every commit writes the lines of its reports below a new version and then one
new snapshot: which version of each report counts, with the report's status, row
count, error, headers and mapping. A snapshot takes effect when its numbered
pointer file appears, which names the folder of its rows and is created only
where no other writer has taken the number; else the commit is made again on
that writer's snapshot. A reader keeps the snapshot it started with, so it sees
all of a replacement or nothing of it.

Lines lie in folders by version and report: the reports of a snapshot prune the
scan, and a removal or a replacement touches no other report's files. `vacuum`
deletes what no kept snapshot names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schemas as S
from marketlens.operators.enrich import order_keys
from marketlens.operators.skew import lookup_join
from marketlens.sources.storage import release

KIND_SCHEMAS = {
    "orders": S.ORDERS_SCHEMA, "combo": S.COMBO_SCHEMA, "cashflow": S.CASHFLOW_SCHEMA, "master": S.MASTER_SCHEMA,
    "adjustments": S.ADJUSTMENT_SCHEMA,
}
ENTRY = (
    T.StructType()
    .add("kind", "string").add("report_id", "string").add("version", "string").add("status", "string").add("row_count", "long")
    .add("error", "string").add("headers", T.ArrayType(T.StringType())).add("mapping", T.MapType(T.StringType(), T.StringType()))
    .add("overridden", "boolean")
)
KEY = ["kind", "report_id"]
# Entries that replace nothing, but end a report.
REMOVED = "removed"


class ReportStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, place: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{place}" if place else self.root)

    # -- snapshots ------------------------------------------------------------

    def _numbers(self) -> list[int]:
        folder = self._path("_snapshots")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def _folder(self, number: int) -> str:
        """Where the rows of a snapshot lie."""
        stream = self._fs.open(self._path(f"_snapshots/{number}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def snapshot(self) -> int:
        """Number of the newest snapshot; 0 before the first commit."""
        return max(self._numbers(), default=0)

    def entries(self, snapshot: int | None = None) -> DataFrame:
        """One row per report of a snapshot, the newest by default."""
        number = self.snapshot() if snapshot is None else snapshot
        if not number:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/{self._folder(number)}")

    def _publish(self, changed: DataFrame, attempts: int = 100) -> int:
        """Make the changed entries part of the next snapshot."""
        for _ in range(attempts):
            number = self.snapshot()
            kept = lookup_join(self.entries(number), changed.select(*KEY), KEY, "left_anti")
            folder = f"_entries/{uuid.uuid4().hex}"
            kept.unionByName(changed).filter(F.col("status") != REMOVED).write.parquet(f"{self.root}/{folder}")
            if self._claim(number + 1, folder):
                return number + 1
        raise RuntimeError("the store is committed to faster than this commit can follow")

    def _claim(self, number: int, folder: str) -> bool:
        """Let a complete pointer file appear under the number, unless another has."""
        jvm, conf = self._jvm, self.spark._jsc.hadoopConfiguration()
        ready, place = self._path(f"_claims/{uuid.uuid4().hex}"), self._path(f"_snapshots/{number}")
        stream = self._fs.create(ready, False)
        try:
            stream.writeUTF(folder)
        finally:
            stream.close()
        self._fs.mkdirs(place.getParent())
        no_overwrite = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        try:
            files.rename(self._fs.makeQualified(ready), self._fs.makeQualified(place), no_overwrite)
        except Exception:
            if self._fs.exists(place):
                return False
            raise
        return True

    # -- writing ----------------------------------------------------------------

    def write_lines(self, kind: str, *parts: DataFrame) -> str:
        """Write lines below a new version, which no snapshot names yet.

        `parts` hold different reports; they are written one after the other, so that the driver plans one at a time.
        """
        version = uuid.uuid4().hex
        order = ["report_id", "order_ts"] if kind == "orders" else ["report_id"]
        for lines in parts:
            sized = lines.select(*KIND_SCHEMAS[kind].names).hint("rebalance", "report_id").sortWithinPartitions(*order)
            sized.write.mode("append").partitionBy("report_id").parquet(f"{self.root}/{kind}/version={version}")
            release(self.spark)
        if kind == "orders":
            order_keys(self.lines_of(kind, version)).coalesce(1).write.parquet(f"{self.root}/_order_keys/version={version}")
        return version

    def order_keys(self, snapshot: int | None = None) -> DataFrame:
        """Sketches of the keys of the ready order reports, as stored with their lines."""
        if not self._fs.exists(self._path("_order_keys")):
            return order_keys(self.table("orders", snapshot))
        kept = self.spark.read.parquet(f"{self.root}/_order_keys")
        return lookup_join(kept, self._live("orders", snapshot), ["report_id", "version"], "left_semi").drop("version")

    def lines_of(self, kind: str, version: str) -> DataFrame:
        """What `write_lines` wrote below a version."""
        return self.spark.read.schema(KIND_SCHEMAS[kind]).parquet(f"{self.root}/{kind}/version={version}")

    def keep(self, table: DataFrame) -> DataFrame:
        """A working table of an intake, written once; `vacuum` deletes it."""
        place = f"{self.root}/_work/{uuid.uuid4().hex}"
        table.write.parquet(place)
        return self.spark.read.schema(table.schema).parquet(place)

    def commit(self, outcomes: DataFrame) -> int:
        """Make outcomes of written reports count, of any kinds at once; returns the snapshot.

        `outcomes` has the columns of a snapshot; it is kept before, so that a
        commit made again does not compute it again.
        """
        return self._publish(self.keep(outcomes.select(*ENTRY.names)))

    def remove(self, reports: DataFrame) -> int:
        """End reports (`kind, report_id`)."""
        blank = {f.name: F.lit(None).cast(f.dataType) for f in ENTRY.fields if f.name not in KEY}
        return self.commit(reports.select(*KEY).withColumns({**blank, "status": F.lit(REMOVED)}))

    # -- reading ----------------------------------------------------------------

    def table(self, kind: str, snapshot: int | None = None) -> DataFrame:
        """Lines of the kind's ready reports; a failed report has none."""
        schema = T.StructType([*KIND_SCHEMAS[kind].fields, T.StructField("version", T.StringType())])
        if not self._fs.exists(self._path(kind)):
            return self.spark.createDataFrame([], KIND_SCHEMAS[kind])
        stored = self.spark.read.schema(schema).parquet(f"{self.root}/{kind}")
        named = lookup_join(stored, self._live(kind, snapshot), ["report_id", "version"], "left_semi")
        return named.select(*KIND_SCHEMAS[kind].names)

    def _live(self, kind: str, snapshot: int | None) -> DataFrame:
        """Which version of each ready report counts."""
        ready = (F.col("kind") == kind) & (F.col("status") == "ready")
        return self.entries(snapshot).filter(ready).select("report_id", "version")

    def vacuum(self, keep: int = 2) -> int:
        """Delete reports' files that none of the newest `keep` snapshots names; returns how many reports' folders went.

        To be called while nothing is taken in: it also deletes the working tables of intakes.
        """
        numbers = self._numbers()
        if len(numbers) <= keep:
            return 0
        place = ["kind", "version", "report_id"]
        entries = [self.entries(n).filter(F.col("version").isNotNull()).select(*place) for n in numbers]
        old, named = (reduce(DataFrame.unionByName, part) for part in (entries[:-keep], entries[-keep:]))
        gone = 0
        for row in old.join(named, place, "left_anti").distinct().toLocalIterator():
            name = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row.report_id)
            gone += self._fs.delete(self._path(f"{row.kind}/version={row.version}/report_id={name}"), True)
        for number in numbers[:-keep]:
            folder = self._folder(number)
            self._fs.delete(self._path(f"_snapshots/{number}"), False)
            self._fs.delete(self._path(folder), True)
        for folder in ("_work", "_claims"):
            self._fs.delete(self._path(folder), True)
        return gone
