from conftest import frame
from marketlens import schemas as S
from marketlens.adapters.star_schema import Star
from marketlens.operators import mapping

# Every field has a header of a strong keyword and decoys of weaker ones around it.
LONG_SHEET = [
    "STT", "Thời gian tạo", "Ngày bán", "Mã đơn hàng", "Trạng thái", "Tên mặt hàng", "Nhóm", "Danh mục", "Khách hàng",
    "SL", "Đơn giá", "Ghi chú giá", "Thành tiền", "Total", "SKU phân loại",
]


def headers(spark, *lists):
    rows = [(f"R{n}", pos, h) for n, hs in enumerate(lists) for pos, h in enumerate(hs)]
    return frame(spark, "report_id string, header_pos int, header string", *rows)


def mapped(df, report_id="R0"):
    return {r.field: r.header for r in df.collect() if r.report_id == report_id}


def test_strong_keywords_win(spark):
    got = mapped(mapping.map_orders(headers(spark, LONG_SHEET)))
    expected = {
        "order_ts": "Ngày bán", "order_id": "Mã đơn hàng", "raw_status": "Trạng thái", "product": "Tên mặt hàng",
        "category": "Danh mục", "customer": "Khách hàng", "qty": "SL", "price": "Đơn giá", "revenue": "Thành tiền",
        "sku_variant": "SKU phân loại",
    }
    assert {k: got.get(k) for k in expected} == expected


def test_identifier_columns_do_not_serve_as_names(spark):
    ids_only = ["Ngày bán", "Mã sản phẩm", "SKU phân loại", "SL"]
    df = mapping.map_orders(headers(spark, ids_only, [*ids_only, "Sản phẩm", "Phân loại"]))
    assert {"product", "category"}.isdisjoint(mapped(df))
    assert (mapped(df, "R1")["product"], mapped(df, "R1")["category"]) == ("Sản phẩm", "Phân loại")


def test_first_header_wins_ties(spark):
    df = mapping.map_orders(headers(spark, ["Ngày in phiếu", "Ngày nhận"]))
    assert mapped(df)["order_ts"] == "Ngày in phiếu"


def test_master_sku_in_either_order(spark):
    names = ["SKU", "SKU phân loại", "Gía vốn", "Mục", "Phân loại SP", "Phân loại kho ONL"]
    df = mapping.map_master(headers(spark, names, names[::-1]))
    for report in ("R0", "R1"):
        got = mapped(df, report)
        assert got["sku"] == "SKU" and got["unit_cost"] == "Gía vốn"
        assert got["warehouse_type"] == "Phân loại kho ONL"


def test_adjustment_dates_are_told_apart(spark):
    names = ["Mã giao dịch", "Ngày hoàn thành thanh toán", "Ngày hoàn thành điều chỉnh đơn hàng"]
    got = mapped(mapping.map_adjustments(headers(spark, names)))
    assert got["adjustment_date"] == names[2] and got["payment_completed_date"] == names[1]


def test_first_match(spark):
    got = mapped(mapping.map_combo(headers(spark, ["SKU COMBO", "Tỉ lệ SKU 1", "SKU1", "SKU COMBO 2"])))
    assert got == {"combo_sku": "SKU COMBO", "ratio1": "Tỉ lệ SKU 1", "sku1": "SKU1"}


def test_override_replaces_the_whole_mapping(spark):
    detected = mapping.map_orders(headers(spark, LONG_SHEET, LONG_SHEET))
    override = frame(
        spark, "report_id string, field string, header string", ("R0", "order_ts", "Thời gian tạo"), ("R0", "category", " ")
    )
    df = mapping.apply_override(detected, override)
    assert mapped(df) == {"order_ts": "Thời gian tạo"}
    assert mapped(df, "R1") == mapped(detected, "R1")


def test_errors_per_kind(spark):
    names = headers(spark, ["Ngày đặt hàng", "Doanh thu"], ["Sản phẩm", "Số lượng", "Giá"], ["Ngày", "Đơn giá"])
    errors = mapping.mapping_errors(names, mapping.map_orders(names), "orders")
    assert {r.report_id: r.error for r in errors.collect()} == {
        "R0": None, "R1": "no_date_column", "R2": "no_revenue_column",
    }
    for kind in ("combo", "master", "cashflow", "adjustments"):
        nothing = mapping.map_by_score(headers(spark, ["zzz"]), S.COMBO_KEYWORDS)
        found = mapping.mapping_errors(headers(spark, ["zzz"]), nothing, kind).first()
        assert found.error == "no_key_column"


def test_headers_are_dealt_by_report_before_they_become_candidates(spark):
    one_task = headers(spark, LONG_SHEET, LONG_SHEET[::-1]).coalesce(1)
    for map_headers in (mapping.map_orders, mapping.map_combo):
        plan = map_headers(one_task)._jdf.queryExecution().executedPlan().toString()
        above, below = plan.split("Generate", 1)
        assert "Exchange" not in above and below.count("Exchange hashpartitioning(report_id") == 1


def test_uploads_of_a_small_file_are_spread_before_they_become_headers(spark):
    listed = Star(spark, "/root/testdata/sf0.001").shop_headers([LONG_SHEET])
    above, below = listed._jdf.queryExecution().executedPlan().toString().split("Generate", 1)
    assert "Exchange" not in above and "REPARTITION_BY_NUM" in below
