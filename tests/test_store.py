"""Versions of reports behind a snapshot, and uploads of all kinds taken into them."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import by, frame
from marketlens import schemas as S
from marketlens.operators import intake, mapping
from marketlens.plans.dashboard import Dashboard
from marketlens.sources.sheets import read_sheets
from marketlens.sources import store as stored
from marketlens.sources.store import KIND_SCHEMAS, ReportStore
from marketlens.streaming.uploads import ingest_uploads, take_in

GIVEN = "report_id string, field string, header string"


def put(root, name, text):
    place = root / name
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text(text, encoding="utf-8")
    return str(place)


@pytest.fixture
def store(spark, tmp_path):
    return ReportStore(spark, str(tmp_path / "store"))


def entries(store):
    return by(store.entries(), "report_id")


def ingest(spark, tmp_path, store):
    ingest_uploads(spark, str(tmp_path / "in"), store, str(tmp_path / "checkpoint"))


def test_all_kinds_by_their_own_headers(spark, tmp_path, store):
    root = tmp_path / "in"
    put(root, "orders/a.csv", "Mã đơn hàng,Ngày,Doanh thu,SKU phân loại hàng,Giá gốc,Số lượng,Trạng thái\nO1,2026-01-01,10,C-1,20,1,Hoàn thành\n")
    put(root, "combo/c.csv", "SKU COMBO,SKU1,SKU2\nC-1,P1-1,P2-1\n")
    put(root, "cashflow/f.csv", "Mã đơn hàng,Phí hoa hồng Tiếp thị liên kết\nO1,-7\n,-5\n")
    put(root, "master/m.csv", "Gía vốn,SKU\n4,P1\n")
    put(root, "adjustments/x.csv", "Mã giao dịch,Số tiền điều chỉnh\nT1,-3\n")
    put(root, "orders/bad.csv", "Mã đơn hàng,Doanh thu\nO2,1\n")
    put(root, "orders/none.csv", "Ngày,Doanh thu\nkhông,1\n")
    put(root, "orders/readme.md", "no report")
    put(root, "other/a.csv", "a,b\n1,2\n")
    ingest(spark, tmp_path, store)
    got = entries(store)
    assert {k: (e["kind"], e["status"], e["row_count"], e["error"]) for k, e in got.items()} == {
        "orders/a.csv": ("orders", "ready", 1, None),
        "combo/c.csv": ("combo", "ready", 2, None),
        "cashflow/f.csv": ("cashflow", "ready", 1, None),
        "master/m.csv": ("master", "ready", 1, None),
        "adjustments/x.csv": ("adjustments", "ready", 1, None),
        "orders/bad.csv": ("orders", "failed", None, "no_date_column"),
        "orders/none.csv": ("orders", "failed", None, "no_valid_rows"),
    }
    assert got["master/m.csv"]["mapping"] == {"sku": "SKU", "unit_cost": "Gía vốn"}
    assert got["combo/c.csv"]["headers"] == ["SKU COMBO", "SKU1", "SKU2"]
    assert store.table("adjustments").collect()[0].amount == -3
    kpi = Dashboard.of_store(store).kpis().collect()[0]
    assert (kpi.row_count, kpi.gross_sales) == (2, 0)  # two parts without ratios
    # The second batch: other headers, another format, and a report that failed before.
    put(root, "orders/b.json", '{"Order date": "02/01/2026", "Đơn giá": 3, "SL": 2}\n')
    put(root, "cashflow/g.csv", "Phí hoa hồng Tiếp thị liên kết;x,Mã đơn hàng gốc\n-1,O9\n")
    ingest(spark, tmp_path, store)
    after = entries(store)
    assert after["orders/b.json"]["mapping"] == {"order_ts": "Order date", "price": "Đơn giá", "qty": "SL"}
    assert after["cashflow/g.csv"]["row_count"] == 1 and {k: after[k] for k in got} == got
    assert sorted(r.revenue for r in store.table("orders").collect()) == [6, 10]
    assert store.snapshot() == 2
    ingest(spark, tmp_path, store)  # nothing new
    assert store.snapshot() == 2


def test_override_replaces_one_report_and_stays(spark, tmp_path, store):
    root = str(tmp_path / "in")
    a = put(tmp_path / "in", "orders/a.csv", "Ngày,Doanh thu,Khác\n2026-01-01,1,5\n2026-01-02,2,6\n")
    b = put(tmp_path / "in", "orders/b.csv", "Ngày,Doanh thu\n2026-01-01,9\n")
    take_in(store, root, [a, b])
    old, before = store.table("orders"), store.snapshot()
    sheet, headers = read_sheets(spark, root, "csv")
    given = frame(spark, GIVEN, ("orders/a.csv", "order_ts", "Ngày"), ("orders/a.csv", "revenue", "Khác"), ("orders/a.csv", "qty", " "))
    intake.reconvert(store, "orders", sheet, headers, given)
    assert sorted(r.revenue for r in store.table("orders").collect()) == [5, 6, 9]
    # A reader from before the swap still gets all of the old lines.
    assert sorted(r.revenue for r in old.collect()) == sorted(r.revenue for r in store.table("orders", before).collect()) == [1, 2, 9]
    # The report arrives again: its given mapping holds.
    a = put(tmp_path / "in", "orders/a.csv", "Ngày,Doanh thu,Khác\n2026-01-01,1,50\n")
    take_in(store, root, [a])
    assert sorted(r.revenue for r in store.table("orders").collect()) == [9, 50]
    assert entries(store)["orders/a.csv"]["overridden"] and not entries(store)["orders/b.csv"]["overridden"]
    # A given mapping without a date fails the report, which then has no lines.
    intake.reconvert(store, "orders", sheet, headers, frame(spark, GIVEN, ("orders/a.csv", "revenue", "Khác")))
    assert [r.revenue for r in store.table("orders").collect()] == [9]
    assert entries(store)["orders/a.csv"]["error"] == "no_date_column"


def fees(spark, *rows):
    return frame(spark, S.CASHFLOW_SCHEMA, *rows)


def outcome(spark, store, lines, *reports, status="ready"):
    version = store.write_lines("cashflow", lines)
    row = "kind string, report_id string, version string, status string, row_count long, error string"
    rows = frame(spark, row, *[("cashflow", r, version, status, 1, None) for r in reports])
    return rows.selectExpr("*", "cast(null as array<string>) headers", "cast(null as map<string,string>) mapping", "false overridden")


def total(table):
    return {r.report_id: r.s for r in table.groupBy("report_id").agg(F.sum("aff_fee").alias("s")).collect()}


def test_lines_count_from_the_commit_on(spark, store):
    assert store.snapshot() == 0 and store.table("cashflow").collect() == [] == store.entries().collect()
    first = outcome(spark, store, fees(spark, ("a", "1", 1.0), ("b/c d%=", "1", 2.0)), "a", "b/c d%=")
    assert store.table("cashflow").collect() == []
    store.commit(first)
    assert total(store.table("cashflow")) == {"a": 1, "b/c d%=": 2}
    store.commit(outcome(spark, store, fees(spark, ("a", "2", 10.0)), "a"))
    assert total(store.table("cashflow")) == {"a": 10, "b/c d%=": 2}
    store.remove(frame(spark, "kind string, report_id string", ("cashflow", "b/c d%="), ("orders", "a")))
    assert total(store.table("cashflow")) == {"a": 10} and total(store.table("cashflow", 1)) == {"a": 1, "b/c d%=": 2}


def test_two_writers_lose_nothing(spark, store, monkeypatch):
    """A commit that finds its number taken is made again on the other's snapshot."""
    other, waiting = ReportStore(spark, store.root), [True]
    claim = store._claim

    def late(number, folder):
        if waiting.pop() if waiting else False:
            other.commit(outcome(spark, other, fees(spark, ("b", "1", 2.0)), "b"))
        return claim(number, folder)

    monkeypatch.setattr(store, "_claim", late)
    assert store.commit(outcome(spark, store, fees(spark, ("a", "1", 1.0)), "a")) == 2
    assert total(store.table("cashflow")) == {"a": 1, "b": 2}


def test_vacuum_keeps_what_counts(spark, store):
    for n in range(4):
        store.commit(outcome(spark, store, fees(spark, ("a", "1", float(n))), "a"))
    store.commit(outcome(spark, store, fees(spark, ("b", "1", 7.0)), "b"))
    assert store.vacuum(keep=2) == 3
    assert total(store.table("cashflow")) == {"a": 3, "b": 7} and total(store.table("cashflow", 4)) == {"a": 3}
    left = [p for p, _, files in os.walk(store.root) if "report_id=" in p and files]
    assert len(left) == 2 and store.vacuum(keep=2) == 0


def test_scans_are_pruned_to_the_reports_that_count(spark, store):
    store.commit(outcome(spark, store, fees(spark, ("a", "1", 1.0), ("b", "1", 2.0)), "a", "b"))
    plan = store.table("cashflow")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    spark.sql("set spark.sql.adaptive.enabled=false")
    try:
        one = store.table("cashflow").filter("report_id = 'a'")
        one.collect()
        scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert "PartitionFilters: [isnotnull(report_id" in scan.toString()
    finally:
        spark.sql("set spark.sql.adaptive.enabled=true")


def written_reports(spark, kinds):
    """Two reports a kind: one complete, of three lines, and one without a mapping."""
    complete = {k: next(iter(mapping.REQUIRED[k].values()))[0] for k in kinds}
    complete = {k: fields + (["revenue"] if k == "orders" else ["aff_fee"] if k == "cashflow" else []) for k, fields in complete.items()}
    return [
        intake.Written(
            kind, f"v-{kind}",
            frame(spark, "report_id string, header_pos int, header string", *[(r, n, f"{kind}{n}") for r in ("a", "b") for n in (1, 0)]),
            frame(spark, GIVEN, *[("a", f, f"h {f}") for f in complete[kind]]),
            frame(spark, "report_id string, n int", ("a", 1), ("a", 2), ("a", 2)),
            frame(spark, GIVEN, ("a", "x", "y"), ("a", "x2", "y")) if kind in ("orders", "combo") else None,
        )
        for kind in kinds
    ]


def test_outcomes_of_all_kinds_are_one_plan(spark):
    kinds = list(KIND_SCHEMAS)
    found = intake.outcomes(written_reports(spark, kinds))
    got = {(r.kind, r.report_id): r for r in found.collect()}
    assert set(got) == {(k, r) for k in kinds for r in ("a", "b")}
    for kind in kinds:
        good, bad = got[kind, "a"], got[kind, "b"]
        assert (good.status, good.row_count, good.error, good.version, good.headers) == ("ready", 3, None, f"v-{kind}", [f"{kind}0", f"{kind}1"])
        assert (bad.status, bad.row_count, bad.error, bad.version, bad.mapping) == ("failed", None, next(iter(mapping.REQUIRED[kind])), None, None)
        assert set(good.mapping) >= set(next(iter(mapping.REQUIRED[kind].values()))[0])
        assert good.overridden == (kind in ("orders", "combo")) and not bad.overridden
    # Five kinds are not shuffled more often than one.
    plans = [intake.outcomes(written_reports(spark, some))._jdf.queryExecution().executedPlan().toString() for some in (["orders"], kinds)]
    shuffles = [plan.count("Exchange") for plan in plans]
    assert shuffles[0] == shuffles[1] > 0


def test_formats_of_a_kind_are_planned_one_by_one(spark, tmp_path, store, monkeypatch):
    released = []
    monkeypatch.setattr(stored, "release", lambda session: released.append(session))
    root = tmp_path / "in"
    put(root, "adjustments/x.csv", "Mã giao dịch,Số tiền điều chỉnh\nT1,-3\n")
    put(root, "adjustments/y.json", '{"Mã giao dịch": "T2", "Số tiền điều chỉnh": "-4"}\n')
    ingest(spark, tmp_path, store)
    assert sorted((r.report_id, r.transaction_id, r.amount) for r in store.table("adjustments").collect()) == [
        ("adjustments/x.csv", "T1", -3), ("adjustments/y.json", "T2", -4),
    ]
    assert len(released) == 2
