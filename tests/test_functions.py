import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import eval_on
from marketlens.functions import dates, numbers, text


def test_strip_accents_and_headers(spark):
    assert eval_on(spark, ["Đơn Giá", "Số Lượng", "  Hủy\t", "Hủy"], text.strip_accents) == [
        "don gia", "so luong", "huy", "huy",
    ]
    assert eval_on(spark, ["Tổng giá trị đơn hàng (VND)", "  SKU--1 "], text.normalize_header) == [
        "tong gia tri don hang vnd", "sku 1",
    ]


def test_text_defaults(spark):
    cells = ["  x ", "", None, " \t"]
    assert eval_on(spark, cells, lambda c: text.text_or_default(c, "?")) == ["x", "?", "?", "?"]
    assert eval_on(spark, cells, text.text_or_empty) == ["x", "", "", ""]


def test_contains_is_like_without_escape(spark):
    cells = ["ABC", "a%c", "a\\bc", "axc"]
    def found(part):
        return eval_on(spark, cells, lambda c: text.contains_pattern(c, part))

    assert found("B") == [True, False, True, False]
    assert found("a_c") == [True, True, False, True]
    assert found("\\b") == [False, False, True, False]


def test_parent_sku(spark):
    assert eval_on(spark, ["A100-1", "A100", "", "A-1-2"], text.parent_sku) == ["A100", "A100", "", "A"]


def test_numbers(spark):
    cells = {
        "295200": 295200.0, "": 0.0, None: 0.0, "1.234.567": 1234567.0, "1.234.567 đ": 1234567.0, "295.5": 295.5,
        "12,5": 12.5, "1,234,567": 0.0, "-47.527": -47527.0, "abc": 0.0, "1.234.567.890": 1234567890.0, "5-": 0.0,
    }
    assert eval_on(spark, list(cells), numbers.text_to_number) == list(cells.values())


def plain_number(cell):
    """The rule, step by step: keep digits and signs, drop thousands dots, read."""
    kept = "".join(ch for ch in cell if ch in "0123456789.,-")
    out = ""
    for i, ch in enumerate(kept):
        after = kept[i + 1 : i + 5]
        thousands = ch == "." and re.fullmatch(r"\d{3}([.,-].*)?", after, re.S) is not None
        out += "" if thousands else ch
    try:
        return float(out.replace(",", "."))
    except ValueError:
        return 0.0


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="0123456789.,- đx", max_size=14), min_size=200, max_size=300))
def test_numbers_follow_the_rule(spark, cells):
    assert eval_on(spark, cells, numbers.text_to_number) == [plain_number(c) for c in cells]


def test_dates(spark):
    d = dt.datetime
    cells = {
        "2026-02-01 00:01": d(2026, 2, 1), "01/02/2026": d(2026, 2, 1), "1-2-2026": d(2026, 2, 1),
        "2026/2/1T10:00": d(2026, 2, 1), "not a date": None, "": None, None: None, "31/02/2026": None,
        "01/13/2026": None, "20260201": d(2026, 2, 1), "6 Feb 2026": d(2026, 2, 6), "Feb 6, 2026": d(2026, 2, 6),
        "Fri, 6 Feb 2026": d(2026, 2, 6), " 2026-02-01 ": d(2026, 2, 1), "46054": None,
    }
    assert eval_on(spark, list(cells), dates.text_to_timestamp) == list(cells.values())


def test_date_serials(spark):
    got = eval_on(spark, [46054.0, 46054.25, 1e12, None], dates.serial_to_timestamp, "double")
    assert got == [dt.datetime(2026, 2, 1), dt.datetime(2026, 2, 1, 6), None, None]


def test_presets(spark):
    as_of = dt.date(2026, 3, 31)
    ranges = [dates.preset_range(p, F.lit(as_of)) for p in dates.PRESETS]
    row = spark.range(1).select(*[F.struct(*r) for r in ranges]).first()
    got = {p: tuple(r) for p, r in zip(dates.PRESETS, row, strict=True)}
    day = dt.date
    assert got == {
        "today": (as_of, as_of),
        "yesterday": (day(2026, 3, 30), day(2026, 3, 30)),
        "last7": (day(2026, 3, 25), as_of),
        "last30": (day(2026, 3, 2), as_of),
        "this_month": (day(2026, 3, 1), as_of),
        "last_month": (day(2026, 2, 1), day(2026, 2, 28)),
        "this_quarter": (day(2026, 1, 1), as_of),
        "last_quarter": (day(2025, 10, 1), day(2025, 12, 31)),
        "this_year": (day(2026, 1, 1), as_of),
        "last_year": (day(2025, 1, 1), day(2025, 12, 31)),
    }


def test_custom_ranges(spark):
    y = F.lit(2024)
    row = spark.range(1).select(
        F.struct(*dates.month_range(y, F.lit(2))),
        F.struct(*dates.quarter_range(y, F.lit(4))),
        F.struct(*dates.year_range(y)),
    ).first()
    day = dt.date
    assert [tuple(r) for r in row] == [
        (day(2024, 2, 1), day(2024, 2, 29)), (day(2024, 10, 1), day(2024, 12, 31)), (day(2024, 1, 1), day(2024, 12, 31)),
    ]
