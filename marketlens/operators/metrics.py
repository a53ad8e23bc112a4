"""KPIs, timeline, top lists and facets over enriched lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import schemas as S
from marketlens.functions.money import exact_sum, scoped, shown_sum

KPI_COLUMNS = [
    "gross_sales", "line_state", "list_price", "net_qty", "returned_qty", "discount", "voucher",
    "platform_fee", "ship_fee", "aff_fee", "cost",
]
TOP_N = 8
SUMMARY_COLUMNS = [*KPI_COLUMNS, "order_ts", "category"]


def _kpi_sums(summed: Callable[[Column], Column] = shown_sum) -> list[Column]:
    c = F.col
    state = c("line_state")

    def in_state(name):
        return F.when(state == name, c("gross_sales")).otherwise(F.lit(0.0))

    totals = {
        "gross_sales": c("gross_sales"),
        "gmv": scoped(state, c("list_price") * c("net_qty")),
        "cancelled_before": in_state(S.STATE_CANCELLED_BEFORE),
        "cancelled_after": in_state(S.STATE_CANCELLED_AFTER),
        "returns": c("list_price") * c("returned_qty"),
        "discount": scoped(state, c("discount")),
        "voucher": scoped(state, c("voucher")),
        "platform_fee": c("platform_fee"),
        "ship_fee": c("ship_fee"),
        "aff_fee": c("aff_fee"),
        "cost": scoped(state, c("cost")),
    }
    return [summed(v).alias(name) for name, v in totals.items()]


def kpi_totals(lines: DataFrame) -> DataFrame:
    """Twelve totals in one pass; 0 where there are no lines."""
    return lines.agg(*_kpi_sums(), F.count(F.lit(1)).alias("row_count"))


def kpi_derived(totals: DataFrame) -> DataFrame:
    """Add net revenue, NMV and gross profit to the totals."""
    c = F.col
    return (
        totals.withColumn("net_revenue", c("gmv") - c("discount") - c("voucher"))
        .withColumn("nmv", c("net_revenue") - c("platform_fee") - c("ship_fee") - c("aff_fee"))
        .withColumn("gross_profit", c("nmv") - c("cost"))
    )


def monthly_timeline(lines: DataFrame) -> DataFrame:
    """Gross sales per calendar month, oldest first."""
    month = F.date_format("order_ts", "yyyy-MM").alias("month")
    return lines.groupBy(month).agg(shown_sum(F.col("gross_sales")).alias("value")).orderBy("month")


def top_by_sales(lines: DataFrame, column: str, n: int = TOP_N) -> DataFrame:
    """The n labels with the highest gross sales; equal sums in label order."""
    return (
        lines.groupBy(F.col(column).alias("label"))
        .agg(shown_sum(F.col("gross_sales")).alias("value"))
        .orderBy(F.col("value").desc_nulls_last(), F.col("label").asc_nulls_last())
        .limit(n)
    )


def summary_sections(lines: DataFrame, listed: dict[str, DataFrame], n: int = TOP_N) -> DataFrame:
    """KPIs, timeline and top lists as `section, label, value`.

    Lines are summed once by month and category, of which there are few; the
    KPIs, the timeline and the categories add these sums up. `listed` brings the
    lines for products and customers with just the label and the sales, so that
    what is shuffled for these many labels is one number each.
    """
    by_month = lines.groupBy(F.date_format("order_ts", "yyyy-MM").alias("month"), "category").agg(
        *_kpi_sums(exact_sum), F.count(F.lit(1)).alias("row_count")
    )
    numbers = [c for c in by_month.columns if c not in ("month", "category")]
    totals = kpi_derived(by_month.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in numbers]))
    kpis = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for c in totals.columns])
    sections = [totals.select(F.lit("kpis").alias("section"), F.inline(kpis))]

    def add(name: str, found: DataFrame, label: str) -> None:
        sections.append(found.select(F.lit(name).alias("section"), F.col(label).alias("label"), "value"))

    add("timeline", by_month.groupBy("month").agg(shown_sum(F.col("gross_sales")).alias("value")), "month")
    add("category_breakdown", top_by_sales(by_month, "category", n), "label")
    add("top_products", top_by_sales(listed["product"], "product", n), "label")
    add("top_customers", top_by_sales(listed["customer"], "customer", n), "label")
    return reduce(DataFrame.unionByName, sections)


def facets(lines: DataFrame) -> DataFrame:
    """Filter choices in long form: `facet, value`.

    Distinct combinations come first, so the six-fold unpivot runs on what is
    left of the lines after the map-side combine.
    """
    combinations = lines.select(*S.FACETS.values()).distinct()
    pairs = F.array(
        *[F.struct(F.lit(name).alias("facet"), F.col(c).alias("value")) for name, c in S.FACETS.items()]
    )
    keeps_blank = F.col("facet").isin(S.FACETS_KEEPING_BLANK)
    return (
        combinations.select(F.inline(pairs))
        .filter(F.col("value").isNotNull() & (keeps_blank | (F.col("value") != "")))
        .distinct()
    )


def facet_order(choices: DataFrame) -> DataFrame:
    """Choices in display order: states by business rank, the rest by Vietnamese alphabet."""
    states = F.array(*[F.lit(s) for s in S.STATE_ORDER])
    rank = F.when(F.col("facet") == "statuses", F.array_position(states, F.col("value"))).otherwise(F.lit(0))
    return choices.withColumn("state_rank", rank.cast("int")).orderBy(
        "facet", "state_rank", F.collate("value", "vi"), "value"
    )
