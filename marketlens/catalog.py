"""Named queries over the benchmark tables, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schemas as S
from marketlens.adapters import star_schema as A
from marketlens.functions import dates, money, numbers, text
from marketlens.operators import convert, enrich, intake, mapping, metrics, paging
from marketlens.operators.filters import Filters
from marketlens.plans.dashboard import Dashboard
from marketlens.session import tune
from marketlens.sources import reports, sheets
from marketlens.sources.bucketed import read_with_fees, write_by_order
from marketlens.sources.storage import release, work_dir
from marketlens.sources.store import ReportStore
from marketlens.streaming.ingest import ingest_available
from marketlens.streaming.uploads import ingest_uploads, take_in, upload_names

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Columns shown with more digits than amounts.
DIGITS = {"paid_ratio": 6, "ratio": 6, "parsed": 6}


def present(df: DataFrame) -> DataFrame:
    """Comparable output: amounts to two digits, ratios to six, timestamps as text.

    Amounts first pass through six decimal digits, so that half a cent is
    always rounded up, whatever a double makes of it.
    """
    def shown(field):
        c = f"`{field.name}`"
        if isinstance(field.dataType, T.DoubleType):
            digits = DIGITS.get(field.name, 2)
            return f"CAST(round(CAST({c} AS DECIMAL(38, 6)), {digits}) AS DOUBLE) AS {c}"
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            return f"date_format({c}, 'yyyy-MM-dd HH:mm:ss') AS {c}"
        if isinstance(field.dataType, T.DateType):
            return f"date_format({c}, 'yyyy-MM-dd') AS {c}"
        return c

    return df.selectExpr(*[shown(f) for f in df.schema.fields])


def query(build: Callable[[A.Star], DataFrame]) -> Callable[[A.Star], DataFrame]:
    @wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return present(build(A.Star(spark, folder)))

    QUERIES[build.__name__] = run
    return build


_written: dict[tuple[str, str, str], str] = {}


def written(star: A.Star, what: str, write: Callable[[str], None]) -> str:
    """Folder of what a session has written for a data folder, once, as an upload is stored once."""
    key = (star.spark.sparkContext.applicationId, star.folder, what)
    if key not in _written:
        path = f"{work_dir(star.spark)}/{what}-{uuid.uuid4().hex}"
        write(path)
        _written[key] = path
    return _written[key]


_boards: dict[str, Dashboard] = {}


def dashboard(star: A.Star) -> Dashboard:
    """Dashboard over the stored tables, opened once."""
    root = written(star, "tables", star.store)
    if root not in _boards:
        _boards[root] = Dashboard(star.stored(root), star.stored_manifest(root))
    return _boards[root]


def landed_sheets(star: A.Star) -> str:
    """Folder of the uploaded order sheets."""
    return written(star, "landing", lambda path: reports.write_reports(star.raw_orders(), path))


def order_sheets(star: A.Star) -> DataFrame:
    return sheets.clean_sheet(reports.read_reports(star.spark, landed_sheets(star)))


def stored_orders(star: A.Star) -> DataFrame:
    """Lines of all reports, ready or not."""
    return star.stored(written(star, "tables", star.store)).orders


KEY = ["report_id", "line_no"]

# ---------------------------------------------------------------------------
# Sources, ingestion, sinks
# ---------------------------------------------------------------------------


def _split_by_age(star: A.Star) -> tuple[DataFrame, DataFrame]:
    """Stored orders of reports without and with the optional columns."""
    orders = stored_orders(star)
    is_old = F.col("report_id") == f"R{A.OLD_YEAR}"
    return orders.filter(is_old).drop(*S.OPTIONAL_ORDER_COLUMNS), orders.filter(~is_old)


@query
def scan_union_by_name(star):
    root = f"{work_dir(star.spark)}/drift-{uuid.uuid4().hex}"
    for age, part in zip(("old", "new"), _split_by_age(star), strict=True):
        part.write.parquet(f"{root}/{age}")
    both = reports.scan_reports(star.spark, f"{root}/old", f"{root}/new")
    return both.select(*KEY, "gross_sales", "discount", "paid_ratio")


@query
def optional_columns(star):
    both = sheets.union_reports(*_split_by_age(star))
    return both.select(*KEY, *[enrich.or_zero(both, c).alias(c) for c in S.OPTIONAL_ORDER_COLUMNS])


@query
def raw_sheet_cleanup(star):
    key = F.col("c_custkey")
    raw = star.table("customer").select(
        F.concat(F.lit("C"), key).alias("report_id"),
        key.alias("line_no"),
        F.when(key % 5 != 0, F.col("c_name")).alias(" shop name "),
        F.when(key % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("balance\t"),
        F.col("c_mktsegment").alias("segment"),
    )
    return sheets.clean_sheet(raw).withColumnRenamed("shop name", "shop_name")


@query
def normalize_headers(star):
    documents = star.table("documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("header")
    )
    headers = star.shop_headers([A.FULL_LAYOUT, A.OTHER_NAMES_LAYOUT]).select(
        F.lit("header").alias("kind"), F.concat_ws("/", "report_id", "header_pos").alias("id"), "header"
    )
    norm = text.normalize_header(F.col("header"))
    return documents.unionByName(headers).select("kind", "id", F.md5(norm).alias("norm_md5"), F.length(norm).alias("n"))


_SHOP_LAYOUTS = [A.FULL_LAYOUT, A.OLD_LAYOUT, A.OTHER_NAMES_LAYOUT, A.NO_DATE_LAYOUT, A.IDS_ONLY_LAYOUT]


@query
def schema_map_scored(star):
    return mapping.map_orders(star.shop_headers(_SHOP_LAYOUTS)).select("report_id", "field", "header", "score")


@query
def schema_map_first_match(star):
    layouts = [A.COMBO_LAYOUT, A.COMBO_LAYOUT[::-1], A.COMBO_LAYOUT[1:]]
    return mapping.map_combo(star.shop_headers(layouts))


@query
def schema_map_override(star):
    key = F.col("c_custkey")
    given = {"order_ts": "Ngày đặt hàng", "product": "SKU phân loại hàng", "category": "", "qty": "Số lượng"}
    override = (
        star.table("customer")
        .filter(key % 10 == 0)
        .select(
            F.concat(F.lit("C"), key).alias("report_id"),
            F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(h).alias("header")) for f, h in given.items()])),
        )
    )
    return mapping.apply_override(mapping.map_orders(star.shop_headers(_SHOP_LAYOUTS)), override)


@query
def header_listing(star):
    return mapping.header_listing(star.shop_headers(_SHOP_LAYOUTS))


@query
def report_validation(star):
    headers = star.order_headers()
    mapped = mapping.map_orders(headers)
    converted = convert.drop_undated(
        convert.typed_order_lines(order_sheets(star), convert.usable_mapping(headers, mapped, "orders"))
    )
    return mapping.report_status(headers, mapped, converted, "orders")


def _number_text():
    """Amounts in eight spellings."""
    whole = F.floor(F.col("l_extendedprice") * 100)
    form = F.col("l_orderkey") % 8
    return (
        F.when(form == 0, A.dong(whole))
        .when(form == 1, F.concat(F.col("l_quantity").cast("int"), F.lit(".5")))
        .when(form == 2, F.concat(F.col("l_quantity").cast("int"), F.lit(",75 VND")))
        .when(form == 3, F.format_number(whole, 0))
        .when(form == 4, F.concat(F.lit("-"), A.grouped_digits(whole)))
        .when(form == 5, F.concat(F.lit("gia "), F.col("l_partkey"), F.lit("."), F.col("l_suppkey"), F.lit(".1234")))
        .when(form == 6, F.lit(""))
        .otherwise(F.concat(F.col("l_linenumber"), F.lit("."), whole, F.lit("-")))
    )


@query
def clean_numbers(star):
    lines = star.table("lineitem").select(A.line_no().alias("line_no"), _number_text().alias("cell"))
    return lines.select("line_no", "cell", numbers.text_to_number(F.col("cell")).alias("parsed"))


def _date_cell():
    """Dates in ten spellings, some of them no dates."""
    form, day = F.col("o_orderkey") % 10, F.col("o_orderdate")
    return (
        F.when(form < 4, A.date_text(day, form))
        .when(form == 4, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T09:30:00")))
        .when(form == 5, F.date_format(day, "dd/13/yyyy"))
        .when(form == 6, F.concat(F.lit("31/"), F.date_format(day, "MM-yyyy")))
        .when(form == 7, F.lit("  "))
        .when(form == 8, F.lit("not a date"))
        .otherwise(F.concat(F.lit("  "), F.date_format(day, "yyyyMMdd"), F.lit("\t")))
    )


@query
def clean_dates(star):
    serial = (F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")) + F.lit(0.25)).cast("double")
    return star.table("orders").select(
        "o_orderkey",
        dates.text_to_timestamp(_date_cell()).alias("from_text"),
        dates.serial_to_timestamp(serial).alias("from_serial"),
    )


@query
def drop_undated_rows(star):
    return convert.drop_undated(star.typed_lines([*KEY, "order_ts", "qty"]))


@query
def text_defaults(star):
    key = F.col("p_partkey")
    cell = F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, F.lit(" \t ")).otherwise(
        F.concat(F.lit("  "), F.col("p_name"), F.lit("\t"))
    )
    return star.table("part").select(
        "p_partkey", text.text_or_default(cell, S.UNKNOWN).alias("named"), text.text_or_empty(cell).alias("plain")
    )


@query
def convert_orders(star):
    headers = star.order_headers()
    return convert.convert_orders(order_sheets(star), headers, mapping.map_orders(headers))


@query
def convert_combo(star):
    headers = star.combo_headers()
    return convert.convert_combo(star.raw_combo(), headers, mapping.map_combo(headers))


@query
def convert_master(star):
    sheet = star.raw_master()
    headers = sheets.headers_of(sheet)
    return convert.convert_master(sheet, headers, mapping.map_master(headers))


@query
def convert_cashflow(star):
    sheet = star.raw_cashflow()
    headers = sheets.headers_of(sheet)
    return convert.convert_cashflow(sheet, headers, mapping.map_cashflow(headers))


@query
def convert_adjustments(star):
    sheet = star.raw_adjustments()
    headers = sheets.headers_of(sheet)
    return convert.convert_adjustments(sheet, headers, mapping.map_adjustments(headers))


@query
def ready_reports(star):
    ready = reports.keep_ready(stored_orders(star), star.manifest(), "orders")
    return ready.groupBy("report_id").agg(F.count(F.lit(1)).alias("lines"), money.shown_sum(F.col("gross_sales")).alias("gross_sales"))


@query
def single_report_summary(star):
    one = dashboard(star).sources.for_report("R1996")
    return Dashboard(one).summary_rows()


@query
def sink_partitioned(star):
    path = f"{work_dir(star.spark)}/sink-{uuid.uuid4().hex}"
    reports.write_reports(star.orders([*KEY, "order_ts", "gross_sales"]), path)
    return reports.read_reports(star.spark, path).select(*KEY, "order_ts", "gross_sales")


@query
def report_removal(star):
    removed = star.manifest().filter(F.col("status") == "processing")
    return reports.remove_reports(stored_orders(star), removed).select(*KEY, "gross_sales")


@query
def incremental_ingest(star):
    root = f"{work_dir(star.spark)}/ingest-{uuid.uuid4().hex}"
    target = f"{root}/orders"
    headers = star.order_headers()
    mapped = mapping.map_orders(headers)

    def convert_sheet(sheet):
        return convert.convert_orders(sheets.clean_sheet(sheet), headers, mapped)

    ingest_available(star.spark, landed_sheets(star), target, f"{root}/checkpoint", convert_sheet)
    return reports.read_reports(star.spark, target, S.ORDERS_SCHEMA)


@query
def ingest_outcomes(star):
    """The manifest after the stream has converted all order sheets."""
    root = f"{work_dir(star.spark)}/ingest-{uuid.uuid4().hex}"
    headers = star.order_headers()
    mapped = mapping.map_orders(headers)

    def convert_sheet(sheet):
        return convert.convert_orders(sheets.clean_sheet(sheet), headers, mapped)

    def judge(lines):
        return mapping.report_status(headers, mapped, lines, "orders")

    ingest_available(
        star.spark, landed_sheets(star), f"{root}/orders", f"{root}/checkpoint", convert_sheet, judge, f"{root}/outcomes"
    )
    listed = reports.list_reports(star.manifest(), "orders")
    after = reports.record_outcomes(listed, reports.read_reports(star.spark, f"{root}/outcomes"))
    return after.select("report_id", "name", "status", "stored", "row_count", "error")


def report_store(star: A.Star) -> ReportStore:
    """Sheets of all kinds uploaded in two batches, the second one with new layouts, each taken in by the stream."""
    def build(root):
        uploads = f"{root}/uploads"
        for batch in (1, 2):
            star.upload(uploads, batch, order_sheets(star))
            release(star.spark)
            ingest_uploads(star.spark, uploads, ReportStore(star.spark, f"{root}/store"), f"{root}/checkpoint")

    return ReportStore(star.spark, f"{written(star, 'uploaded', build)}/store")


def uploaded_for() -> Column:
    """The report a file was uploaded for: a folder of its path."""
    return F.regexp_extract("report_id", "report_id=([^/]+)", 1).alias("report_id")


@query
def uploaded_reports(star):
    """Outcome of every uploaded report of every kind, with the headers found in it and the mapping used."""
    pairs = F.transform(F.array_sort(F.map_entries("mapping")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return report_store(star).entries().select(
        "kind", uploaded_for(), "status", "row_count", "error", F.array_join("headers", "|").alias("headers"), F.array_join(pairs, "|").alias("mapping")
    )


@query
def uploaded_orders(star):
    """Order lines converted from CSV, JSON and Parquet uploads."""
    return report_store(star).table("orders").select(uploaded_for(), *S.ORDERS_SCHEMA.names[2:])


@query
def uploaded_combo(star):
    return report_store(star).table("combo").withColumn("report_id", uploaded_for())


@query
def uploaded_master(star):
    return report_store(star).table("master").withColumn("report_id", uploaded_for())


@query
def uploaded_cashflow(star):
    return report_store(star).table("cashflow").withColumn("report_id", uploaded_for())


@query
def uploaded_adjustments(star):
    return report_store(star).table("adjustments").select(uploaded_for(), *S.ADJUSTMENT_SCHEMA.names[2:])


@query
def uploaded_kpis(star):
    """KPIs over all that was uploaded: orders with combos, fees and costs."""
    return Dashboard.of_store(report_store(star)).kpis()


@query
def uploaded_groups(star):
    """Grouped detail over all that was uploaded."""
    return Dashboard.of_store(report_store(star)).grouped("warehouse_type")


# A mapping given for a report: these fields and no others.
GIVEN = {
    "order_ts": "Ngày đặt hàng", "order_id": "Mã đơn hàng", "product": "SKU phân loại hàng", "sku_variant": "SKU phân loại hàng",
    "qty": "Số lượng", "list_price": "Giá gốc", "revenue": "Số tiền người mua thanh toán", "category": " ",
    "raw_status": "Trạng Thái Đơn Hàng",
}


@query
def reconverted_orders(star):
    """Lines stored after two reports were converted again by a given mapping, and one was removed."""
    uploads = report_store(star).root.removesuffix("store") + "uploads"
    store = ReportStore(star.spark, f"{work_dir(star.spark)}/reconverted-{uuid.uuid4().hex}")
    files = upload_names(star.spark, f"{uploads}/orders")
    take_in(store, uploads, files)
    sheet, headers = sheets.read_sheets(star.spark, uploads, "csv", [f for f in files if f.endswith(".csv")])
    named = headers.filter(uploaded_for().isin("R1996", "R1998")).select("report_id").distinct()
    given = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(h).alias("header")) for f, h in GIVEN.items()]))
    intake.reconvert(store, "orders", sheet, headers, named.select("report_id", given))
    store.remove(store.entries().filter(uploaded_for() == "R1999"))
    return store.table("orders").select(uploaded_for(), *S.ORDERS_SCHEMA.names[2:])


# ---------------------------------------------------------------------------
# Row derivations
# ---------------------------------------------------------------------------


def _derived(star, *columns):
    return star.orders([*KEY, *columns])


@query
def parent_sku(star):
    lines = star.typed_lines([*KEY, "sku_variant"])
    return lines.withColumn("sku", text.parent_sku(F.col("sku_variant")))


@query
def net_quantity(star):
    return _derived(star, "qty", "returned_qty", "net_qty")


@query
def gross_sales(star):
    return _derived(star, "gross_sales")


@query
def line_state(star):
    return _derived(star, "raw_status", "line_state")


@query
def revenue_fallback(star):
    return _derived(star, "price", "revenue")


@query
def paid_ratio(star):
    ratio = F.round(F.col("paid_ratio") * 1e6).cast("long").alias("paid_ppm")
    return _derived(star, "paid_ratio").select(*KEY, ratio)


@query
def discount_amount(star):
    return _derived(star, "discount")


@query
def voucher_amount(star):
    return _derived(star, "voucher")


@query
def platform_fee(star):
    return _derived(star, "platform_fee")


@query
def ship_fee_first_line(star):
    return _derived(star, "ship_fee")


def _lines(star, *columns, filters=None):
    return dashboard(star).lines(filters or Filters(), [*S.LINE_KEY, *columns])


@query
def row_gmv(star):
    return _lines(star, "line_state", "gmv")


@query
def row_scoped_discounts(star):
    lines = _lines(star, "line_state", "discount", "voucher")
    state = F.col("line_state")
    return lines.select(
        *S.LINE_KEY,
        money.scoped(state, F.col("discount")).alias("scoped_discount"),
        money.scoped(state, F.col("voucher")).alias("scoped_voucher"),
    )


@query
def row_net_revenue(star):
    return _lines(star, "net_revenue")


@query
def row_nmv(star):
    return _lines(star, "nmv")


@query
def row_cost(star):
    return _lines(star, "cost")


@query
def row_gross_profit(star):
    return _lines(star, "gross_profit")


@query
def ship_fee_exploded(star):
    return _lines(star, "ship_fee")


@query
def combo_labels(star):
    return _lines(star, "warehouse_type", "item_group", "product_type", "cost")


@query
def combo_scaling(star):
    return _lines(
        star, "qty", "returned_qty", "net_qty", "price", "list_price", "revenue", "gross_sales", "discount",
        "voucher", "platform_fee", "aff_fee",
    )


# ---------------------------------------------------------------------------
# Joins and set operations
# ---------------------------------------------------------------------------


@query
def combo_explosion(star):
    sources = dashboard(star).sources
    return enrich.explode_combo(sources.order_lines([*KEY, "sku_variant"]), sources.combo).select(
        *S.LINE_KEY, "ratio"
    )


@query
def aff_fee_join(star):
    sources = dashboard(star).sources
    lines = sources.order_lines([*KEY, "order_id", "paid_ratio"])
    return enrich.join_aff_fee(lines, sources.cashflow).select(*KEY, "order_id", "line_aff_fee")


@query
def aff_fee_bucketed(star):
    """The same shares from lines and fees stored by order, without a shuffle."""
    def build(root):
        sources = dashboard(star).sources
        write_by_order(sources.order_lines([*KEY, "order_id", "paid_ratio"]), sources.cashflow, root)

    lines = read_with_fees(star.spark, written(star, "by-order", build), [*KEY, "order_id", "paid_ratio"])
    share = F.coalesce("paid_ratio", F.lit(0.0)) * F.col("order_aff_fee")
    return lines.select(*KEY, "order_id", share.alias("line_aff_fee"))


@query
def master_lookup(star):
    sources = dashboard(star).sources
    return enrich.join_master(sources.order_lines([*KEY, "sku_variant"]), sources.master)


@query
def channel_tagging(star):
    sources = dashboard(star).sources
    return enrich.tag_channels(sources.order_lines([*KEY, "qty"]), sources.channels)


@query
def channel_lookup(star):
    return reports.report_channels(star.manifest(), star.channels())


@query
def union_reports(star):
    old, new = _split_by_age(star)
    return sheets.union_reports(old, new, old).select(*KEY, "gross_sales", "voucher")


@query
def missing_side_inputs(star):
    orders_only = enrich.Sources(dashboard(star).sources.orders)
    return Dashboard(orders_only).lines(columns=[*KEY, *S.DETAIL_COLUMNS])


@query
def enriched_lines(star):
    return _lines(star, *[c for c in S.DETAIL_COLUMNS if c not in S.LINE_KEY])


# ---------------------------------------------------------------------------
# Filters
# ---------------------------------------------------------------------------
DATE_FROM, DATE_TO = "1996-03-15", "1998-06-30"
_SALES = ["gross_sales", "gmv"]


def _filtered(star, filters, *extra):
    return _lines(star, *_SALES, *extra, filters=filters)


@query
def filter_date_range(star):
    return _filtered(star, Filters(date_from=DATE_FROM, date_to=DATE_TO), "order_ts")


@query
def filter_before_join(star):
    return dashboard(star).grouped("sales_channel", Filters(date_from=DATE_FROM, date_to=DATE_TO))


@query
def filter_category(star):
    return _filtered(star, Filters(category="ECONOMY"), "category")


@query
def filter_status_in(star):
    return _filtered(star, Filters(status=[S.STATE_COMPLETED, "", S.STATE_DELIVERING]), "line_state")


@query
def filter_warehouse_in(star):
    return _filtered(star, Filters(warehouse_type=["Kho 1", "combo"]), "warehouse_type")


@query
def filter_item_group_in(star):
    return _filtered(star, Filters(item_group=["Brand#2", "Brand#4"]), "item_group")


@query
def filter_product_type_in(star):
    return _filtered(star, Filters(product_type="SMALL"), "product_type")


@query
def filter_channel_in(star):
    return _filtered(star, Filters(sales_channel=["Sàn A", "", "Cửa hàng"]), "sales_channel")


@query
def filter_sku_like(star):
    return _filtered(star, Filters(sku="p1_3-"), "sku")


@query
def filter_search(star):
    return _filtered(star, Filters(search="RED%ring"), "product", "order_id")


@query
def filter_path(star):
    path = [("category", "ECONOMY"), ("no_such_key", "x"), ("sales_channel", "")]
    return _filtered(star, Filters(path=path), "category", "sales_channel")


def _range_rows(rows, ranges):
    options = [
        F.struct(F.lit(name).alias("preset"), first.alias("first_day"), last.alias("last_day"))
        for name, (first, last) in ranges.items()
    ]
    return rows.select("*", F.inline(F.array(*options)))


@query
def time_presets(star):
    days = star.table("orders").select(F.col("o_orderdate").cast("date").alias("as_of")).distinct()
    return _range_rows(days, {p: dates.preset_range(p, F.col("as_of")) for p in dates.PRESETS})


@query
def time_custom_range(star):
    day = F.col("o_orderdate")
    parts = star.table("orders").select(
        F.year(day).alias("y"), F.quarter(day).alias("q"), F.month(day).alias("m")
    ).distinct()
    y = F.col("y")
    return _range_rows(
        parts,
        {
            "month": dates.month_range(y, F.col("m")),
            "quarter": dates.quarter_range(y, F.col("q")),
            "year": dates.year_range(y),
        },
    )


# ---------------------------------------------------------------------------
# Aggregations
# ---------------------------------------------------------------------------


@query
def kpi_totals(star):
    return metrics.kpi_totals(dashboard(star).lines(columns=metrics.KPI_COLUMNS))


@query
def kpi_derived(star):
    return dashboard(star).kpis()


@query
def monthly_timeline(star):
    return dashboard(star).timeline()


@query
def top_products(star):
    return dashboard(star).top("product")


@query
def category_breakdown(star):
    return dashboard(star).top("category")


@query
def top_customers(star):
    return dashboard(star).top("customer")


@query
def facets(star):
    return dashboard(star).facets(Filters(date_from=DATE_FROM, category="ECONOMY"))


@query
def summary_bundle(star):
    return dashboard(star).summary_rows(Filters(date_from=DATE_FROM, date_to=DATE_TO, category="ECONOMY"))


@query
def facet_order(star):
    return metrics.facet_order(dashboard(star).facets())


# ---------------------------------------------------------------------------
# Groups
# ---------------------------------------------------------------------------


def _register_grouped(key):
    def build(star):
        return dashboard(star).grouped(key)

    build.__name__ = f"grouped_by_{key}"
    query(build)


for _key in S.GROUP_KEYS:
    _register_grouped(_key)


@query
def grouped_total(star):
    return dashboard(star).group_totals(["sku", "order_id", "product"])


@query
def grouped_page(star):
    return dashboard(star).grouped_page("sku", sort="nmv", direction="asc", number=3)


@query
def grouped_nested(star):
    return dashboard(star).grouped("status", Filters().under(("category", "SMALL"), ("sales_channel", "Sàn B")))


@query
def grouped_tree_rollup(star):
    return dashboard(star).group_tree(["category", "status", "product"])


# ---------------------------------------------------------------------------
# Sort, paging, export
# ---------------------------------------------------------------------------


@query
def detail_sorted(star):
    return dashboard(star).rows(sort="gross_sales", direction="desc")


@query
def detail_page(star):
    return dashboard(star).rows_page(sort="gross_sales", direction="desc", number=4)


@query
def detail_next_page(star):
    """The page after the fourth, found by that page's last row."""
    board = dashboard(star)
    shown = board.rows_page(sort="gross_sales", direction="desc", number=4, keys=True).collect()
    return board.rows_after(shown[-1], sort="gross_sales", direction="desc")


@query
def detail_deep_page(star):
    """Rows 15,001 to 15,015 from the numbered copy that all pages of this order share."""
    board = dashboard(star)
    path = written(star, "pages", lambda path: board.write_pages(path, sort="gross_sales", direction="desc"))
    return board.stored_page(path, number=1001)


@query
def detail_total(star):
    return dashboard(star).rows_total(Filters(search="red")).withColumn(
        "pages", F.greatest(F.ceil(F.col("total") / paging.PAGE_SIZE), F.lit(1)).cast("long")
    )


@query
def detail_drilldown(star):
    under = Filters().under(("category", "SMALL"), ("status", S.STATE_COMPLETED), ("sales_channel", "Sàn B"))
    return dashboard(star).rows(under)


@query
def adjustments_page(star):
    rows = star.adjustments().filter(F.col("report_id") == "A1").drop("report_id")
    return paging.page(rows, [F.col("line_no")], number=2)


@query
def report_listing(star):
    return reports.list_reports(star.manifest(), "orders").select("report_id", "name", "uploaded_at", "status")


@query
def export_detail(star):
    path = f"{work_dir(star.spark)}/export-{uuid.uuid4().hex}"
    paging.write_export(dashboard(star).rows(), path, "parquet")
    return star.spark.read.parquet(path)


@query
def export_grouped(star):
    path = f"{work_dir(star.spark)}/export-{uuid.uuid4().hex}"
    groups = dashboard(star).grouped("customer").orderBy(*paging.group_order("gross_profit", "asc"))
    paging.write_export(groups, path, "parquet")
    return star.spark.read.parquet(path)


@query
def export_projection(star):
    return dashboard(star).export(["order_id", "no_such_column", "gross_sales", "line_state", "sku_variant"])


