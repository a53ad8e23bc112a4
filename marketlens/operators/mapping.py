"""Header-to-field mapping of many reports at once.

Headers travel as a table `report_id, header_pos, header`; a mapping is a
table `report_id, field, header`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import schemas as S
from marketlens.functions.text import normalize_header, trim_text


def header_listing(headers: DataFrame, report_id: str | None = None) -> DataFrame:
    """Original headers in file order, of one report or of all."""
    if report_id is not None:
        headers = headers.filter(F.col("report_id") == report_id)
    return headers.select("report_id", "header_pos", "header").orderBy("report_id", "header_pos")


def _keyword_score(words: list[str]) -> str:
    """Best score of a normalised header `norm` over the keywords of one field; 0 where none occurs in it."""
    scores = [
        f"CASE WHEN norm = '{w}' THEN {S.EXACT_MATCH_BONUS + len(w)} WHEN contains(norm, '{w}') THEN {len(w)} ELSE 0 END"
        for w in words
    ]
    return f"greatest({', '.join(scores)})" if len(scores) > 1 else scores[0]


def _candidates(headers: DataFrame, keywords: dict[str, list[str]], penalised: list[str]) -> DataFrame:
    """One row per header and field the header could serve, with its score."""
    options = []
    for field, words in keywords.items():
        penalty = " - penalty" if field in penalised else ""
        options.append(f"struct('{field}' AS field, {_keyword_score(words)}{penalty} AS score)")
    looks_like_id = F.col("norm").rlike(S.IDENTIFIER_PREFIX)
    return (
        headers.withColumn("norm", normalize_header(F.col("header")))
        .withColumn("penalty", F.when(looks_like_id, S.IDENTIFIER_PENALTY).otherwise(F.lit(0)))
        .selectExpr("report_id", "header_pos", "header", f"inline(array({', '.join(options)}))")
        .filter(F.col("score") > 0)
    )


def _by_report(headers: DataFrame) -> DataFrame:
    """Headers dealt by report, before each becomes several candidates.

    However few tasks have read them, all tasks score them, and what a task
    sorts for its reports is bounded by the size of a shuffled partition. The
    candidates of a report are together then, and are not shuffled again.
    """
    return headers.select("report_id", "header_pos", "header").repartition("report_id")


def map_by_score(
    headers: DataFrame, keywords: dict[str, list[str]], penalised: list[str] | None = None
) -> DataFrame:
    """Per report and field the header with the best score; the first one in file order among equals."""
    rank = F.struct(F.col("score"), -F.col("header_pos"))
    return (
        _candidates(_by_report(headers), keywords, penalised or [])
        .groupBy("report_id", "field")
        .agg(F.max_by("header", rank).alias("header"), F.max("score").alias("score"))
    )


def map_by_first_match(headers: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """Per report and field the first header in file order that contains a keyword."""
    return (
        _candidates(_by_report(headers), keywords, [])
        .groupBy("report_id", "field")
        .agg(F.min_by("header", "header_pos").alias("header"))
    )


def map_orders(headers: DataFrame) -> DataFrame:
    return map_by_score(headers, S.ORDER_KEYWORDS, S.NAME_LIKE_FIELDS)


def map_combo(headers: DataFrame) -> DataFrame:
    return map_by_first_match(headers, S.COMBO_KEYWORDS)


def map_master(headers: DataFrame) -> DataFrame:
    return map_by_score(headers, S.MASTER_KEYWORDS)


def map_cashflow(headers: DataFrame) -> DataFrame:
    return map_by_first_match(headers, S.CASHFLOW_KEYWORDS)


def map_adjustments(headers: DataFrame) -> DataFrame:
    return map_by_score(headers, S.ADJUSTMENT_KEYWORDS)


def apply_override(detected: DataFrame, override: DataFrame) -> DataFrame:
    """A report named in `override` uses only its rows there, without blank ones; others keep the detected mapping."""
    columns = ["report_id", "field", "header"]
    kept = detected.join(override.select("report_id").distinct(), "report_id", "left_anti")
    given = override.filter(trim_text(F.coalesce("header", F.lit(""))) != "")
    return kept.select(*columns).unionByName(given.select(*columns))


# Fields a report of each kind must have; any one complete group is enough.
REQUIRED = {
    "orders": {"no_date_column": [["order_ts"]], "no_revenue_column": [["revenue"], ["price", "qty"]]},
    "combo": {"no_key_column": [["combo_sku"]]},
    "master": {"no_key_column": [["sku"]]},
    "cashflow": {"no_key_column": [["order_id"]], "no_fee_column": [["aff_fee"]]},
    "adjustments": {"no_key_column": [["transaction_id"]]},
}
NO_VALID_ROWS = "no_valid_rows"


def missing_fields(kind: str, known: Column) -> Column:
    """What keeps a report with these mapped fields from being converted; NULL where all required ones are there."""
    error = None
    for name, groups in REQUIRED[kind].items():
        complete = F.lit(False)
        for group in groups:
            has_all = F.lit(True)
            for field in group:
                has_all = has_all & F.array_contains(known, field)
            complete = complete | has_all
        error = F.when(~complete, name) if error is None else error.when(~complete, name)
    return error


def known_fields() -> Column:
    return F.coalesce("fields", F.array().cast("array<string>"))


def outcome(missing: Column, rows: Column) -> dict[str, Column]:
    """Status, row count and error of a report, from what its mapping lacks and how many rows it gave."""
    rows = F.coalesce(rows, F.lit(0)).cast("long")
    error = F.coalesce(missing, F.when(rows == 0, NO_VALID_ROWS))
    return {
        "status": F.when(error.isNull(), "ready").otherwise("failed"),
        "row_count": F.when(error.isNull(), rows),
        "error": error,
    }


def mapping_errors(headers: DataFrame, mapping: DataFrame, kind: str) -> DataFrame:
    """`report_id, error` for every report; error is NULL where all required fields are mapped."""
    reports = headers.select("report_id").distinct()
    fields = mapping.groupBy("report_id").agg(F.collect_set("field").alias("fields"))
    error = missing_fields(kind, known_fields())
    return reports.join(fields, "report_id", "left").select("report_id", error.alias("error"))


def report_status(headers: DataFrame, mapping: DataFrame, converted: DataFrame, kind: str) -> DataFrame:
    """Outcome of a conversion: `report_id, status, row_count, error`."""
    counts = converted.groupBy("report_id").agg(F.count(F.lit(1)).alias("row_count"))
    rows = mapping_errors(headers, mapping, kind).join(counts, "report_id", "left")
    return rows.select("report_id", *[c.alias(name) for name, c in outcome(F.col("error"), F.col("row_count")).items()])
