import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import BASE_HEADERS, by, convert_sheet, frame
from marketlens import schemas as S
from marketlens.operators import filters as flt
from marketlens.operators.enrich import Sources, enrich
from marketlens.operators.filters import Filters
from marketlens.plans.dashboard import Dashboard
from marketlens.sources import reports, sheets


@pytest.fixture(scope="module")
def base(base_orders):
    return Dashboard(Sources(base_orders))


@pytest.fixture(scope="module")
def combo(spark):
    return frame(
        spark, "combo_sku string, sub_sku string, ratio double, slot int",
        ("GH52-1", "LE3-1", 0.25, 1), ("GH52-1", "LE4-1", 0.75, 2),
    )


@pytest.fixture(scope="module")
def cashflow(spark):
    return frame(spark, "order_id string, aff_fee double", ("P5", 3600.0))


MASTER = "sku string, item_group string, product_type string, warehouse_type string, unit_cost double"


@pytest.fixture(scope="module")
def master(spark):
    return frame(
        spark, MASTER, ("GH52", "Bàn ghế", "Gỗ", "Kho Bắc", 15000.0), ("TR18", "Treo tường", "Giấy", "Kho Nam", 40000.0)
    )


def kpis(board, filters=Filters()):
    return board.kpis(filters).first().asDict()


def ids(df):
    return {r.order_id for r in df.collect()}


def test_kpis(base):
    k = kpis(base)
    assert (k["gross_sales"], k["gmv"], k["row_count"]) == (1111000, 680000, 6)
    assert (k["cancelled_before"], k["cancelled_after"], k["returns"]) == (140000, 180000, 111000)
    assert k["ship_fee"] == 5 * 1620 and k["nmv"] == 680000 - 5 * 1620
    fees = {r.order_id: r.ship_fee for r in base.rows().collect()}
    assert fees == {"K11": 1620, "K12": 0, "K13": 1620, "K14": 1620, "K15": 1620, "K16": 1620}


def test_returns_count_in_every_state(spark):
    row = ["K20", "2026-03-21", "Đã hủy", "Giao hàng thất bại", "NL07-2", "Nón len", "Nón", 45000, 2, 5, 3]
    assert kpis(Dashboard(Sources(convert_sheet(spark, BASE_HEADERS, [row]))))["returns"] == 3 * 45000


def test_discounts(split_orders):
    k = kpis(Dashboard(Sources(split_orders)))
    assert k["gmv"] == 160000 + 210000 + 180000
    assert (k["discount"], k["voucher"]) == (3200 + 2500 + 700, 20000)
    assert k["net_revenue"] == 550000 - 6400 - 20000 == 523600
    assert (k["platform_fee"], k["ship_fee"], k["aff_fee"], k["nmv"]) == (0, 1620, 0, 523600 - 1620)


def test_aff_fee(spark, split_orders, cashflow):
    board = Dashboard(Sources(split_orders, cashflow=cashflow))
    shares = {r.sku_variant: r.aff_fee for r in board.rows().collect()}
    assert shares == {"GH52-1": 900, "TR18-4": 1800, "VI09-1": 900} and kpis(board)["aff_fee"] == 3600
    later = cashflow.unionByName(frame(spark, "order_id string, aff_fee double", ("P5", 400.0)))
    assert kpis(Dashboard(Sources(split_orders, cashflow=later)))["aff_fee"] == 4000


def test_combo(split_orders, combo, cashflow):
    plain, board = Dashboard(Sources(split_orders)), Dashboard(Sources(split_orders, combo, cashflow))
    rows = by(board.rows(), "sku_variant")
    shown = {k: (r["sku"], r["qty"], r["gross_sales"], r["ship_fee"], r["aff_fee"]) for k, r in rows.items()}
    assert shown == {
        "LE3-1": ("LE3", 2, 40000, 1620, 225), "LE4-1": ("LE4", 2, 120000, 0, 675),
        "TR18-4": ("TR18", 1, 210000, 0, 1800), "VI09-1": ("VI09", 3, 180000, 0, 900),
    }
    before, after = kpis(plain), kpis(board)
    assert [before[n] - after[n] for n in ("gross_sales", "gmv", "discount", "voucher", "ship_fee")] == [0] * 5
    assert after["row_count"] == before["row_count"] + 1


def test_master(spark, split_orders, master, combo):
    rows = by(Dashboard(Sources(split_orders, master=master)).rows(), "sku_variant")
    assert {k: (r["warehouse_type"], r["cost"]) for k, r in rows.items()} == {
        "GH52-1": ("Kho Bắc", 30000), "TR18-4": ("Kho Nam", 40000), "VI09-1": ("", 0),
    }
    other = frame(spark, MASTER, ("QQ1", "?", "?", "?", 9.0))
    rows = Dashboard(Sources(split_orders, master=other)).rows().collect()
    assert {(r.warehouse_type, r.cost) for r in rows} == {("", 0)}
    parts = frame(spark, MASTER, ("LE3", "Bàn ghế", "Gỗ", "Kho Bắc", 6000.0), ("LE4", "Bàn ghế", "Gỗ", "Kho Nam", 9000.0))
    rows = by(Dashboard(Sources(split_orders, combo, master=parts)).rows(), "sku_variant")
    assert (rows["LE3-1"]["cost"], rows["LE4-1"]["cost"]) == (12000, 18000)
    assert {rows[k][n] for k in ("LE3-1", "LE4-1") for n in ("item_group", "warehouse_type")} == {"combo"}
    assert Dashboard(Sources(split_orders, master=master.unionByName(master))).rows().count() == 3


def test_cost_only_in_gmv_states(spark, base_orders):
    skus = ["NL07", "UM31", "NA12", "DQ44", "NC90", "GV28"]
    master = frame(spark, MASTER, *[(s, "?", "?", "?", 1500.0) for s in skus])
    k = kpis(Dashboard(Sources(base_orders, master=master)))
    assert k["cost"] == (5 + 1 + 2) * 1500 and k["gross_profit"] == k["nmv"] - 12000


def test_old_and_new_reports_together(spark, base_orders, split_orders):
    old = base_orders.filter("order_id = 'K15'").drop(*S.OPTIONAL_ORDER_COLUMNS)
    assert kpis(Dashboard(Sources(old)))["nmv"] == 310000
    k = kpis(Dashboard(Sources(sheets.union_reports(old, split_orders))))
    assert (k["row_count"], k["ship_fee"], k["net_revenue"]) == (4, 1620, 310000 + 523600)


def test_missing_paid_ratio_gives_no_aff_fee(split_orders, cashflow):
    assert kpis(Dashboard(Sources(split_orders.drop("paid_ratio"), cashflow=cashflow)))["aff_fee"] == 0


def test_channels(spark, base_orders):
    tagged = base_orders.withColumn("report_id", F.when(F.col("order_id") < "K13", "R1").otherwise(F.lit("R2")))
    manifest = frame(
        spark, "report_id string, kind string, status string, stored boolean, channel_id string, uploaded_at timestamp",
        ("R1", "orders", "ready", True, "c1", dt.datetime(2026, 1, 1)),
        ("R2", "orders", "ready", True, "gone", dt.datetime(2026, 1, 2)),
        ("R3", "orders", "failed", False, None, dt.datetime(2026, 1, 3)),
    )
    names = frame(spark, "channel_id string, name string", ("c1", "Sàn A"))
    board = Dashboard(Sources(tagged, channels=reports.report_channels(manifest, names)))
    groups = by(board.grouped("sales_channel"), "group_value")
    assert {k: r["row_count"] for k, r in groups.items()} == {"Sàn A": 2, "": 4}
    assert ids(board.rows(Filters(sales_channel=["Sàn A", ""]))) == {"K11", "K12"}
    assert [r.value for r in board.facets().filter("facet = 'sales_channels'").collect()] == ["Sàn A"]
    one = Dashboard(board.sources.for_report("R1"))
    assert one.rows_total().first().total == 2
    assert {r.sales_channel for r in one.rows().collect()} == {""}
    assert [r.report_id for r in reports.list_reports(manifest, "orders").collect()] == ["R3", "R2", "R1"]
    assert {r.report_id for r in reports.ready_reports(manifest, "orders").collect()} == {"R1", "R2"}


def test_filters(base):
    assert ids(base.rows(Filters(category="Nón"))) == {"K11", "K13", "K15"}
    assert ids(base.rows(Filters(status=[S.STATE_RETURNED, S.STATE_DELIVERING]))) == {"K13", "K16"}
    assert ids(base.rows(Filters(status=S.STATE_PARTLY_RETURNED))) == {"K14"}
    assert base.rows_total(Filters(status=[])).first().total == 6
    assert ids(base.rows(Filters(search="nón c"))) == {"K15"}
    assert ids(base.rows(Filters(sku="um31"))) == {"K12"}
    assert ids(base.rows(Filters(path=[("category", "Giày dép"), ("status", S.STATE_DELIVERING)]))) == {"K16"}
    assert base.rows_total(Filters(path=[("nothing", "x")])).first().total == 6
    with pytest.raises(ValueError):
        flt.check_path([("nothing", "x")])


def test_dates_cover_whole_days(spark, base_orders):
    late = base_orders.withColumn("order_ts", F.col("order_ts") + F.expr("INTERVAL 23 HOURS"))
    board = Dashboard(Sources(late))
    assert ids(board.rows(Filters(date_to=dt.date(2026, 3, 11)))) == {"K11"}
    assert board.rows_total(Filters(date_to="2026-03-10")).first().total == 0
    assert ids(board.rows(Filters(date_from="2026-03-13", date_to="2026-03-14"))) == {"K13", "K14"}


def test_date_filter_reaches_the_scan(spark, base_orders, combo, tmp_path):
    base_orders.write.parquet(str(tmp_path / "o"))
    sources = Sources(spark.read.parquet(str(tmp_path / "o")), combo)
    plan = enrich(sources, ["gross_sales"], "2026-03-12")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(order_ts), GreaterThanOrEqual(order_ts" in plan
    assert "ReadSchema: struct<order_ts:timestamp_ntz,sku_variant:string,gross_sales:double>" in plan


def test_facets_follow_dates_only(base):
    filters = Filters(status=S.STATE_COMPLETED, date_to="2026-03-13")
    got = {(r.facet, r.value) for r in base.facets(filters).collect()}
    assert {v for f, v in got if f == "statuses"} == {S.STATE_CANCELLED_AFTER, S.STATE_CANCELLED_BEFORE, S.STATE_RETURNED}
    assert {v for f, v in got if f == "categories"} == {"Nón", "Giày dép"}
    assert not [v for f, v in got if f == "warehouse_types"]


def test_facet_order(spark):
    from marketlens.operators.metrics import facet_order

    choices = frame(
        spark, "facet string, value string", ("statuses", S.STATE_CANCELLED_AFTER), ("statuses", S.STATE_COMPLETED),
        *[("item_groups", v) for v in ("Quần", "Đầm", "Áo", "Balo")],
    )
    got = [r.value for r in facet_order(choices).collect()]
    assert got == ["Áo", "Balo", "Đầm", "Quần", S.STATE_COMPLETED, S.STATE_CANCELLED_AFTER]


def test_empty_source():
    board = Dashboard(Sources(None))
    k = kpis(board)
    assert all(v == 0 for v in k.values())
    assert board.rows().count() == 0 and board.facets().count() == 0 and board.timeline().count() == 0


def summary_of(board, filters=Filters()):
    return {(r.section, r.label): r.value for r in board.summary_rows(filters).collect()}


def test_summary_of_nothing(spark):
    got = summary_of(Dashboard(Sources(None)))
    assert {section for section, _ in got} == {"kpis"} and set(got.values()) == {0.0}


def test_summary_holds_its_parts(split_orders, combo, cashflow):
    board = Dashboard(Sources(split_orders, combo, cashflow))
    got = summary_of(board)
    parts = board.summary()
    want = {("kpis", k): pytest.approx(float(v)) for k, v in parts["kpis"].first().asDict().items()}
    want |= {("timeline", r.month): pytest.approx(r.value) for r in parts["timeline"].collect()}
    for name in ("top_products", "category_breakdown", "top_customers"):
        want |= {(name, r.label): pytest.approx(r.value) for r in parts[name].collect()}
    want |= {(r.facet, r.value): None for r in parts["facets"].collect()}
    assert got == want


def test_only_ready_reports_count(spark, split_orders, combo):
    orders = split_orders.withColumn("report_id", F.lit("R1"))
    parts = combo.withColumn("report_id", F.lit("K1"))

    def board(order_state, stored, combo_state):
        manifest = frame(
            spark, "report_id string, kind string, status string, stored boolean",
            ("R1", "orders", order_state, stored), ("K1", "combo", combo_state, True), ("K1", "orders", "ready", True),
        )
        return Dashboard(Sources(orders, parts), manifest)

    whole = Dashboard(Sources(orders, parts)).rows().count()
    plain = Dashboard(Sources(orders)).rows().count()
    assert whole > plain
    assert board("ready", True, "ready").rows().count() == whole
    assert board("ready", True, "processing").rows().count() == plain
    assert board("processing", True, "ready").rows().count() == board("ready", False, "ready").rows().count() == 0


def test_top_and_timeline(base):
    assert [(r.label, r.value) for r in base.top("product", n=3).collect()] == [
        ("Nón cối", 310000), ("Dép quai", 216000), ("Giày vải", 190000),
    ]
    assert [(r.month, r.value) for r in base.timeline().collect()] == [("2026-03", 1111000)]


def test_groups(base):
    groups = {r.group_value: (r.row_count, r.gross_sales) for r in base.grouped("category").collect()}
    assert groups == {"Nón": (3, 565000), "Giày dép": (3, 546000)}
    assert [r.group_value for r in base.grouped_page("category", size=1, number=2).collect()] == ["Giày dép"]
    assert [r.group_value for r in base.grouped_page("category", direction="asc").collect()] == ["Giày dép", "Nón"]
    assert base.group_total("status").first().total == 6
    assert base.grouped("nothing").count() == 0
    nested = base.grouped("status", Filters().under(("category", "Giày dép")))
    assert {r.group_value: r.row_count for r in nested.collect()} == {
        S.STATE_CANCELLED_BEFORE: 1, S.STATE_PARTLY_RETURNED: 1, S.STATE_DELIVERING: 1,
    }


def test_tree_has_every_level(base):
    rows = base.group_tree(["category", "status"]).collect()
    assert sorted((r.depth, r.row_count) for r in rows) == [(1, 3), (1, 3)] + [(2, 1)] * 6
    assert sum(r.gross_sales for r in rows if r.depth == 1) == 1111000


def test_rows_reconcile_with_kpis_and_groups(split_orders, master, combo, cashflow):
    board = Dashboard(Sources(split_orders, combo, cashflow, master))
    k = kpis(board)
    rows, groups = board.rows().collect(), board.grouped("sku").collect()
    for name in ("gmv", "net_revenue", "nmv", "gross_profit"):
        assert sum(r[name] for r in rows) == pytest.approx(k[name])
        assert sum(r[name] for r in groups) == pytest.approx(k[name])


def test_sort_puts_nulls_last_both_ways(spark, base_orders):
    odd = base_orders.withColumn("category", F.when(F.col("order_id") != "K13", F.col("category")))
    board = Dashboard(Sources(odd))
    for direction in ("asc", "desc"):
        assert [r.order_id for r in board.rows(sort="category", direction=direction).collect()][-1] == "K13"
    assert [r.order_id for r in board.rows(sort="drop table").collect()] == ["K11", "K12", "K13", "K14", "K15", "K16"]


def test_export(base, tmp_path):
    out = base.export(["order_id", "nothing", "product", "gross_sales"])
    assert out.columns == ["Mã đơn hàng", "Sản phẩm", "Doanh số"] and out.count() == 6
    groups = base.export(["group_value", "row_count", "gross_sales"], group_key="category")
    assert groups.columns == ["Danh mục", "Số dòng", "Doanh số"] and groups.count() == 2
    none = base.export(["order_id"], Filters(category="x"))
    assert none.columns == ["Mã đơn hàng"] and none.count() == 0
    with pytest.raises(ValueError):
        base.export(["nothing"])
    with pytest.raises(ValueError):
        base.export(["group_value"], group_key="nothing")


def test_unneeded_joins_are_left_out(split_orders, master, combo, cashflow):
    board = Dashboard(Sources(split_orders, combo, cashflow, master))

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    for name in ("order_aff_fee", "unit_cost"):
        assert name not in plan(board.timeline()) and name in plan(board.kpis())
