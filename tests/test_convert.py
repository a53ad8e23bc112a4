import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import BASE_HEADERS, BASE_ROWS, MONEY_HEADERS, by, convert_sheet, frame, make_sheet
from marketlens import schemas as S
from marketlens.operators import convert, mapping
from marketlens.sources import sheets


def test_six_states(base_orders):
    rows = by(base_orders, "order_id")
    assert {k: r["line_state"] for k, r in rows.items()} == {
        "K11": S.STATE_CANCELLED_AFTER, "K12": S.STATE_CANCELLED_BEFORE, "K13": S.STATE_RETURNED,
        "K14": S.STATE_PARTLY_RETURNED, "K15": S.STATE_COMPLETED, "K16": S.STATE_DELIVERING,
    }
    assert {k: r["gross_sales"] for k, r in rows.items()} == {
        "K11": 180000, "K12": 140000, "K13": 75000, "K14": 216000, "K15": 310000, "K16": 190000,
    }
    assert all(r["ship_fee"] == 1620 and r["discount"] == r["voucher"] == r["paid_ratio"] == 0 for r in rows.values())
    assert rows["K11"]["order_ts"] == dt.datetime(2026, 3, 11)
    assert rows["K11"]["customer"] == S.UNKNOWN
    assert rows["K14"]["net_qty"] == 5 and rows["K14"]["revenue"] == 12
    assert base_orders.columns == S.ORDERS_SCHEMA.names


def money_row(order, sku, qty, subsidy, voucher, paid, fees, date="2026-02-01"):
    return [order, date, "Hoàn thành", "", sku, "SP", "Áo", 100000, 1, qty, 0, subsidy, voucher, paid, *fees]


def test_shares_of_an_order(spark):
    rows = [
        money_row("M", "A-1", 2, 4000, 10000, 300000, (1000, 2000, 500)),
        money_row("M", "B-1", 1, 6000, 10000, 700000, (1000, 2000, 500)),
        money_row("S", "C-1", 1, 1000, 5000, 50000, (500, 300, 200)),
        money_row("Z", "D-1", 0, 1000, 5000, 0, (500, 300, 200)),
    ]
    got = by(convert_sheet(spark, MONEY_HEADERS, rows), "sku_variant")
    assert [got[k]["paid_ratio"] for k in ("A-1", "B-1", "C-1", "D-1")] == [0.3, 0.7, 1.0, 0.0]
    assert [got[k]["voucher"] for k in ("A-1", "B-1", "C-1", "D-1")] == [3000, 7000, 5000, 0]
    assert [got[k]["discount"] for k in ("A-1", "B-1", "C-1", "D-1")] == [4000, 6000, 1000, 0]
    assert [got[k]["platform_fee"] for k in ("A-1", "B-1", "C-1")] == [pytest.approx(1050), pytest.approx(2450), 1000]
    assert [got[k]["ship_fee"] for k in ("A-1", "B-1", "C-1", "D-1")] == [1620, 0, 1620, 1620]


def test_undated_lines_count_for_shares_but_not_for_the_first_line(spark):
    rows = [
        money_row("M", "A-1", 1, 0, 1000, 400, (0, 0, 0), date="no date"),
        money_row("M", "B-1", 1, 0, 1000, 600, (0, 0, 0)),
    ]
    got = by(convert_sheet(spark, MONEY_HEADERS, rows), "sku_variant")
    assert list(got) == ["B-1"]
    assert got["B-1"]["paid_ratio"] == 0.6 and got["B-1"]["ship_fee"] == 1620


def test_blank_order_ids_share_one_order(spark):
    rows = [money_row("", f"A-{n}", 1, 0, 0, 100, (0, 0, 0)) for n in range(4)]
    got = by(convert_sheet(spark, MONEY_HEADERS, rows), "sku_variant")
    assert sorted(r["ship_fee"] for r in got.values()) == [0, 0, 0, 1620]
    assert got["A-0"]["ship_fee"] == 1620
    assert all(r["paid_ratio"] == 0.25 for r in got.values())


def test_orders_are_kept_apart_by_report(spark):
    rows = [money_row("M", "A-1", 1, 0, 0, 100, (0, 0, 0))]
    both = make_sheet(spark, MONEY_HEADERS, rows, "R1").unionByName(make_sheet(spark, MONEY_HEADERS, rows, "R2"))
    names = sheets.headers_of(both)
    got = convert.convert_orders(both, names, mapping.map_orders(names)).collect()
    assert [r.ship_fee for r in got] == [1620, 1620] and [r.paid_ratio for r in got] == [1, 1]


def test_unmapped_order_column_means_one_order(spark):
    keep = [i for i, h in enumerate(BASE_HEADERS) if h != "Mã đơn hàng"]
    headers = [BASE_HEADERS[i] for i in keep]
    got = convert_sheet(spark, headers, [[r[i] for i in keep] for r in BASE_ROWS]).collect()
    assert sorted(r.ship_fee for r in got) == [0] * 5 + [1620]
    assert {r.order_id for r in got} == {""}


def test_cells_keep_their_type(spark):
    headers = ["Ngày đặt hàng", "Đơn giá", "Số lượng", "Mã đơn hàng"]
    rows = [[dt.datetime(2026, 2, 1, 10, 30), 1234.567, "2", 7], [None, 1.0, "1", 8]]
    got = convert_sheet(spark, headers, rows).collect()
    assert len(got) == 1
    assert got[0].order_ts == dt.datetime(2026, 2, 1, 10, 30)
    assert got[0].price == 1234.567 and got[0].revenue == 2469.134
    serial = convert_sheet(spark, headers, [[46054.5, 1.0, "1", "x"]]).first()
    assert serial.order_ts == dt.datetime(2026, 2, 1, 12)


def test_override_is_used_for_conversion(spark):
    sheet = make_sheet(spark, BASE_HEADERS, BASE_ROWS)
    names = sheets.headers_of(sheet)
    given = {"order_ts": "Ngày đặt hàng", "product": "SKU phân loại hàng", "qty": "Số lượng", "price": "Giá gốc"}
    override = frame(
        spark, "report_id string, field string, header string", *[("R1", f, h) for f, h in given.items()]
    )
    mapped = mapping.apply_override(mapping.map_orders(names), override)
    got = convert.convert_orders(sheet, names, mapped)
    assert got.count() == 6 and got.orderBy("line_no").first().product == "NL07-2"


def test_reports_that_cannot_be_converted(spark):
    no_date = make_sheet(spark, ["Sản phẩm", "Số lượng", "Đơn giá"], [["A", 1, 1000]], "R1")
    no_rows = make_sheet(spark, ["Ngày", "Doanh thu"], [["x", 5.0]], "R2")
    good = make_sheet(spark, ["Ngày", "Doanh thu"], [["2026-01-01", 5.0]], "R3")
    sheet = sheets.union_reports(no_date, no_rows, good)
    names = sheets.headers_of(no_date).unionByName(sheets.headers_of(no_rows)).unionByName(sheets.headers_of(good))
    mapped = mapping.map_orders(names)
    converted = convert.convert_orders(sheet, names, mapped)
    status = by(mapping.report_status(names, mapped, converted, "orders"), "report_id")
    assert (status["R1"]["status"], status["R1"]["error"]) == ("failed", "no_date_column")
    assert (status["R2"]["status"], status["R2"]["error"]) == ("failed", "no_valid_rows")
    assert (status["R3"]["status"], status["R3"]["row_count"], status["R3"]["error"]) == ("ready", 1, None)


def test_combo(spark):
    headers = ["PHÂN LOẠI", "Tỉ lệ SKU 1", "Tỉ lệ SKU 2", "Tỉ lệ SKU 3", "SKU1", "SKU2", "SKU3", "SKU COMBO"]
    rows = [
        ["bộ", 0.35, 0.65, None, "GH52-1", "TR18-4", "", "BO-NHA"],
        ["túi", 0.1, 0.15, 0.75, "VI09-1", "NL07-2", "DQ44-2", "BO-DI"],
        ["không tên", 0.1, 0.15, 0.75, "VI09-1", "NL07-2", "DQ44-2", " "],
    ]
    got = convert_sheet(spark, headers, rows, "combo").orderBy("combo_sku", "slot").collect()
    assert [(r.combo_sku, r.sub_sku, r.ratio, r.slot) for r in got] == [
        ("BO-DI", "VI09-1", 0.1, 1), ("BO-DI", "NL07-2", 0.15, 2), ("BO-DI", "DQ44-2", 0.75, 3),
        ("BO-NHA", "GH52-1", 0.35, 1), ("BO-NHA", "TR18-4", 0.65, 2),
    ]
    no_ratio = convert_sheet(spark, ["SKU COMBO", "SKU1"], [["K", "A-1"]], "combo").first()
    assert no_ratio.ratio == 0


def test_cashflow_and_master(spark):
    headers = ["Mã giao dịch", "Mã đơn hàng", "Phí hoa hồng Tiếp thị liên kết", "Ghi chú"]
    fees = by(convert_sheet(spark, headers, [["G81", "P5", -7300, ""], ["G82", " ", -1, ""]], "cashflow"), "order_id")
    assert {k: r["aff_fee"] for k, r in fees.items()} == {"P5": 7300}
    master = convert_sheet(spark, ["SKU phân loại", "SKU", "Giá vốn"], [["A-1", " A ", 10.5], ["B-1", "", 1.0]], "master")
    assert [(r.sku, r.item_group, r.unit_cost) for r in master.collect()] == [("A", "", 10.5)]


def test_adjustments(spark):
    only_id = convert_sheet(spark, ["Mã giao dịch"], [["T1"], [""], ["T2"]], "adjustments").orderBy("line_no").collect()
    assert [(r.transaction_id, r.amount, r.reason) for r in only_id] == [("T1", 0, ""), ("T2", 0, "")]


def test_no_python_in_the_plan_and_pruned_scan(spark, tmp_path):
    make_sheet(spark, MONEY_HEADERS, [money_row("M", "A-1", 1, 0, 0, 1, (0, 0, 0))]).write.parquet(str(tmp_path / "s"))
    sheet = spark.read.parquet(str(tmp_path / "s"))
    names = sheets.headers_of(sheet)
    lines = convert.typed_order_lines(sheet, mapping.map_orders(names))
    state_only = convert.derive_orders(lines, ["report_id", "line_state"])
    plan = state_only._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" not in plan
    assert state_only.agg(F.count("line_state")).first()[0] == 1
