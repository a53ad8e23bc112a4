"""Reading raw sheets: uploads of many reports, each with its own headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.sources.csv_records import read_records
from marketlens.sources.files import file_line_no, file_report_id


def read_sheets(
    spark: SparkSession, path: str, fmt: str = "parquet", files: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """All uploaded sheets below `path`, or some `files` of them, one file per report, as (sheet, headers).

    CSV files bring a header line each, whatever the others look like; their
    cells come by position, in one array. JSON and Parquet files share the
    columns of all; a report has those it fills.
    """
    if fmt == "csv":
        return read_records(spark, path, files=files)
    reader = spark.read.option("recursiveFileLookup", True)
    if fmt == "parquet":
        reader = reader.option("mergeSchema", True)
    raw = reader.format(fmt).load(files or path)
    sheet = raw.select(file_report_id(path).alias("report_id"), file_line_no().alias("line_no"), "*")
    return clean_sheet(sheet), filled_headers(sheet)


def clean_sheet(raw: DataFrame) -> DataFrame:
    """Trim header names; blank cells of text columns become ''. Number and date cells keep their type."""
    def cell(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        return c.alias(field.name.strip())

    return raw.select(*[cell(f) if f.name not in ("report_id", "line_no") else f.name for f in raw.schema.fields])


def headers_of(sheet: DataFrame) -> DataFrame:
    """Header table of sheets that share one column list: `report_id, header_pos, header`."""
    names = [c.strip() for c in sheet.columns if c not in ("report_id", "line_no")]
    reports = sheet.select("report_id").distinct()
    return reports.select("report_id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("header_pos", "header"))


def filled_headers(raw: DataFrame) -> DataFrame:
    """Header table of sheets read together: of each report the columns in which it has a cell."""
    names = [c for c in raw.columns if c not in ("report_id", "line_no")]
    filled = raw.groupBy("report_id").agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(f"_{n}") for n, c in enumerate(names)])
    listed = [F.struct(F.lit(n).alias("header_pos"), F.lit(c.strip()).alias("header"), F.col(f"_{n}").alias("filled")) for n, c in enumerate(names)]
    rows = filled.select("report_id", F.explode(F.array(*listed)).alias("h"))
    return rows.filter("h.filled").select("report_id", "h.header_pos", "h.header")


def union_reports(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, columns matched by name, missing ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
