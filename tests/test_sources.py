import json
import uuid

from pyspark.sql import functions as F

from conftest import by, frame
from marketlens.operators import convert, mapping
from marketlens.sources import files, reports, sheets
from marketlens.streaming.ingest import ingest_available


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def converted(spark, path, fmt):
    sheet, headers = sheets.read_sheets(spark, path, fmt)
    return convert.convert_orders(sheet, headers, mapping.map_orders(headers)), headers


def test_csv_reports_with_different_headers(spark, tmp_path):
    write(tmp_path / "in", "R1.csv", "Mã đơn hàng,Ngày, Doanh thu \nO1,2026-01-01,10\nO1,2026-01-02,\nO1,x,5\n")
    write(tmp_path / "in", "R2.csv", 'Order date,Đơn giá,SL\n03/01/2026,"1.500",2\n')
    write(tmp_path / "in", "R3.csv", "Mã đơn hàng,Ngày, Doanh thu \nO1,2026-01-05,7\n")
    got, headers = converted(spark, str(tmp_path / "in"), "csv")
    rows = sorted((r.report_id, str(r.order_ts.date()), r.revenue, r.ship_fee) for r in got.collect())
    assert rows == [
        ("R1.csv", "2026-01-01", 10, 1620), ("R1.csv", "2026-01-02", 0, 0), ("R2.csv", "2026-01-03", 3000, 1620),
        ("R3.csv", "2026-01-05", 7, 1620),
    ]
    listed = mapping.header_listing(headers, "R1.csv").collect()
    assert [r.header for r in listed] == ["Mã đơn hàng", "Ngày", "Doanh thu"]


def test_json_reports(spark, tmp_path):
    lines = [{"Ngày": "2026-01-01", "Doanh thu": 10}, {"Ngày": "2026-01-02", "Doanh thu": 1.5}]
    write(tmp_path / "in", "R1.json", "\n".join(json.dumps(x) for x in lines))
    got, _ = converted(spark, str(tmp_path / "in"), "json")
    assert sorted(r.revenue for r in got.collect()) == [1.5, 10]


def test_line_numbers_follow_the_file(spark, tmp_path):
    body = "".join(f"row {n} {'x' * 200}\n" for n in range(30000))
    write(tmp_path / "in", "big.txt", body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        rows = spark.read.text(str(tmp_path / "in")).select(files.file_line_no().alias("n"), "value")
        assert rows.rdd.getNumPartitions() > 3
        values = [int(r.value.split()[1]) for r in rows.orderBy("n").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert values == list(range(30000))


def table(spark, *rows):
    return frame(spark, "report_id string, v int", *rows)


def test_sink_replaces_only_written_reports(spark, tmp_path):
    path = str(tmp_path / "t")
    reports.write_reports(table(spark, ("007", 1), ("R2", 2)), path)
    reports.write_reports(table(spark, ("R2", 3), ("R2", 4)), path)
    got = sorted((r.report_id, r.v) for r in reports.read_reports(spark, path).collect())
    assert got == [("007", 1), ("R2", 3), ("R2", 4)]


def test_scan_of_old_and_new_reports(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    table(spark, ("R1", 1)).drop("v").write.parquet(old)
    table(spark, ("R2", 2)).write.parquet(new)
    got = by(reports.scan_reports(spark, old, new), "report_id")
    assert got["R1"]["v"] is None and got["R2"]["v"] == 2


def test_removed_reports_vanish(spark):
    kept = reports.remove_reports(table(spark, ("R1", 1), ("R2", 2)), table(spark, ("R1", 0)))
    assert [r.report_id for r in kept.collect()] == ["R2"]


def test_sheet_cleanup(spark):
    raw = spark.createDataFrame([(None, float("nan")), (" x", 1.0)], "` a ` string, b double")
    got = sheets.clean_sheet(raw)
    assert got.columns == ["a", "b"]
    assert sorted((r.a, r.b) for r in got.filter(F.col("b").isNotNull()).collect()) == [(" x", 1.0)]
    assert {r.a for r in got.collect()} == {"", " x"}


def sheet_rows(spark, report_id, start, n):
    return frame(
        spark,
        "report_id string, line_no bigint, `Mã đơn hàng` string, `Ngày` string, `Số tiền người mua thanh toán` double",
        *[(report_id, start + i, "O1", "2026-01-01", float(start + i + 1)) for i in range(n)],
    )


def test_stream_equals_batch_even_when_a_report_grows(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / x) for x in ("landing", "target", "checkpoint"))

    def arrive(df):
        df.write.mode("append").partitionBy("report_id").parquet(landing)

    def convert_all(sheet):
        headers = sheets.headers_of(sheet)
        return convert.convert_orders(sheet, headers, mapping.map_orders(headers))

    def stored():
        rows = reports.read_reports(spark, target).select("report_id", "line_no", "paid_ratio", "ship_fee").collect()
        return sorted(map(tuple, rows))

    def batch():
        sheet = reports.read_reports(spark, landing)
        rows = convert_all(sheet).select("report_id", "line_no", "paid_ratio", "ship_fee").collect()
        return sorted(map(tuple, rows))

    arrive(sheet_rows(spark, "R1", 0, 3).unionByName(sheet_rows(spark, "R2", 0, 2)))
    ingest_available(spark, landing, target, checkpoint, convert_all)
    first = stored()
    assert first == batch() and len(first) == 5
    ingest_available(spark, landing, target, checkpoint, convert_all)  # nothing new
    assert stored() == first
    arrive(sheet_rows(spark, "R2", 2, 2).unionByName(sheet_rows(spark, "R3", 0, 1)))
    ingest_available(spark, landing, target, checkpoint, convert_all)
    assert stored() == batch() and len(stored()) == 8


def test_parquet_reports_keep_their_own_headers(spark, tmp_path):
    folder = str(tmp_path / "in")
    frame(spark, "`Ngày đặt hàng` string, `Doanh thu` double", ("2026-04-01", 5.0)).coalesce(1).write.parquet(folder + "/ra")
    frame(spark, "`Order date` string, `Doanh thu` double", ("2026-04-02", 6.0)).coalesce(1).write.parquet(folder + "/rb")
    got, headers = converted(spark, folder, "parquet")
    assert sorted((str(r.order_ts.date()), r.revenue) for r in got.collect()) == [("2026-04-01", 5), ("2026-04-02", 6)]
    assert headers.select("report_id").distinct().count() == 2


def test_reports_are_told_apart_by_their_whole_path(spark, tmp_path):
    text = "Ngày,Doanh thu\n2026-04-0{},1\n"
    for n, name in enumerate(["orders.2026.01.csv", "orders.2026.02.csv", "don hang 7+%.csv"]):
        write(tmp_path / "in", name, text.format(n + 1))
    (tmp_path / "in" / "b").mkdir()
    write(tmp_path / "in" / "b", "orders.2026.01.csv", text.format(4))
    got, _ = converted(spark, str(tmp_path / "in"), "csv")
    assert {r.report_id: r.order_ts.day for r in got.collect()} == {
        "orders.2026.01.csv": 1, "orders.2026.02.csv": 2, "don hang 7+%.csv": 3, "b/orders.2026.01.csv": 4,
    }


def test_cells_may_hold_line_breaks_and_files_other_widths(spark, tmp_path):
    write(tmp_path / "in", "R1.csv", 'Ngày,Sản phẩm,Doanh thu\n2026-04-01,"hai\ndòng, một ô",4\n')
    write(tmp_path / "in", "R2.csv", "a,b,c,d,Doanh thu,Ngày\n1,2,3,4,9,2026-04-02\n")
    got, _ = converted(spark, str(tmp_path / "in"), "csv")
    assert {(r.report_id, r.product, r.revenue) for r in got.collect()} >= {("R1.csv", "hai\ndòng, một ô", 4.0)}
    assert {r.report_id: r.revenue for r in got.collect()} == {"R1.csv": 4, "R2.csv": 9}


def test_numeric_ids_stay_plain_digits(spark, tmp_path):
    folder = str(tmp_path / "in")
    frame(spark, "`Mã đơn hàng` double, `Ngày` string, `Doanh thu` double", (577012345678.0, "2026-04-01", 5.5)).write.parquet(folder)
    got, _ = converted(spark, folder, "parquet")
    assert [r.order_id for r in got.collect()] == ["577012345678"]


def test_reports_that_turn_empty_lose_their_lines(spark, tmp_path):
    path = str(tmp_path / "t")
    reports.write_reports(frame(spark, "report_id string, n int", ("a b", 1), ("c", 2)), path)
    reports.drop_stored(spark, path, ["a b", "never stored"])
    assert [r.report_id for r in reports.read_reports(spark, path).collect()] == ["c"]


def test_outcomes_follow_the_reports(spark, tmp_path):
    landing, target, outcomes = (str(tmp_path / d) for d in ("landing", "target", "outcomes"))

    def convert(sheet):
        return sheet.filter("day IS NOT NULL")

    def judge(lines):
        listed = spark.createDataFrame([("good",), ("empty",)], "report_id string")
        counts = lines.groupBy("report_id").count()
        return listed.join(counts, "report_id", "left").selectExpr(
            "report_id", "CASE WHEN count > 0 THEN 'ready' ELSE 'failed' END AS status", "count AS row_count",
            "CASE WHEN count IS NULL THEN 'no_valid_rows' END AS error",
        )

    def arrive(*rows):
        frame = spark.createDataFrame(rows, "report_id string, line_no long, day string")
        frame.write.mode("append").partitionBy("report_id").parquet(landing)
        ingest_available(spark, landing, target, str(tmp_path / "checkpoint"), convert, judge, outcomes)
        return {r.report_id: (r.status, r.row_count, r.error) for r in reports.read_reports(spark, outcomes).collect()}

    failed = ("failed", None, "no_valid_rows")
    assert arrive(("good", 1, "a"), ("good", 2, "b"), ("empty", 1, None)) == {"good": ("ready", 2, None), "empty": failed}
    assert arrive(("good", 3, "c")) == {"good": ("ready", 3, None), "empty": failed}
    manifest = spark.createDataFrame(
        [("good", "processing", False), ("empty", "ready", True), ("later", "processing", False)],
        "report_id string, status string, stored boolean",
    )
    after = reports.record_outcomes(manifest, reports.read_reports(spark, outcomes))
    assert {r.report_id: (r.status, r.stored, r.row_count, r.error) for r in after.collect()} == {
        "good": ("ready", True, 3, None), "empty": ("failed", False, None, "no_valid_rows"),
        "later": ("processing", False, None, None),
    }


def test_a_stream_converts_each_report_once(spark, tmp_path):
    """Which reports have lines is noted while they are written."""
    landing, runs = str(tmp_path / "landing"), tmp_path / "runs"
    runs.mkdir()
    sheet_rows(spark, "R1", 0, 3).coalesce(1).write.partitionBy("report_id").parquet(landing)

    def convert_all(sheet):
        def noted(batches):
            (runs / uuid.uuid4().hex).touch()
            yield from batches

        return sheet.mapInArrow(noted, sheet.schema)

    ingest_available(spark, landing, str(tmp_path / "target"), str(tmp_path / "checkpoint"), convert_all)
    assert reports.read_reports(spark, str(tmp_path / "target")).count() == 3
    assert len(list(runs.iterdir())) == 1
