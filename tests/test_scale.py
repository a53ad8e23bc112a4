"""Joins under skew and paging without a single task, forced by small limits."""

import pytest
from pyspark.sql import functions as F

from conftest import frame
from marketlens import schemas as S
from marketlens.adapters import star_schema
from marketlens.operators import paging, skew
from marketlens.operators.convert import with_order_facts
from marketlens.operators.enrich import Sources, enrich, order_keys
from marketlens.plans.dashboard import Dashboard
from marketlens.sources import reports
from marketlens.sources.bucketed import read_with_fees, write_by_order


@pytest.fixture
def tiny_limits(monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_MAX_BYTES", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    monkeypatch.setattr(skew, "SPREAD", 8)


def skewed(spark, n=3000):
    """A third of the rows has one key, some have none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None))
    return spark.range(n).select("id", key.otherwise((F.col("id") % 40).cast("string")).alias("k"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, tiny_limits, how):
    left = skewed(spark)
    right = spark.range(30).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([("hot", 1), ("hot", 2)], "k string, v bigint")
    )
    got = skew.lookup_join(left, right, ["k"], how)
    assert "_salt" not in got.columns
    want = left.join(right, ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_hot_keys_are_spread(spark, tiny_limits):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1)], "k string, v bigint")
    plan = skew.lookup_join(left, right, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "_salt" in plan
    salts = left.filter("k = 'hot'").select(F.pmod(F.xxhash64("id", "k"), F.lit(8)).alias("s")).distinct().count()
    assert salts == 8


def test_enrichment_without_broadcast(spark, tiny_limits):
    orders = skewed(spark, 600).select(
        F.lit("R1").alias("report_id"), F.col("id").alias("line_no"), F.coalesce("k", F.lit("")).alias("order_id"),
        F.concat(F.lit("P"), F.col("id") % 7, F.lit("-1")).alias("sku_variant"), F.lit(1.0).alias("net_qty"),
        F.lit(10.0).alias("list_price"), F.lit(S.STATE_COMPLETED).alias("line_state"), F.lit(0.5).alias("paid_ratio"),
    )
    combo = frame(spark, "combo_sku string, sub_sku string, ratio double, slot int", ("P1-1", "Q1-1", 1.0, 1), ("P1-1", "Q2-1", 0.0, 2))
    cashflow = frame(spark, "order_id string, aff_fee double", ("hot", 4.0), ("3", 2.0), ("3", 2.0))
    master = frame(
        spark, "sku string, item_group string, product_type string, warehouse_type string, unit_cost double",
        ("P0", "a", "b", "c", 3.0), ("Q2", "a", "b", "c", 5.0),
    )
    sources = Sources(orders, combo, cashflow, master)
    columns = ["line_no", "slot", "sku", "aff_fee", "cost", "warehouse_type", "gmv"]
    salted = sorted(map(str, enrich(sources, columns).collect()))
    skew.BROADCAST_MAX_BYTES = 1 << 62
    assert salted == sorted(map(str, enrich(sources, columns).collect()))
    assert len(salted) == 600 + 86


def test_small_side_is_broadcast(spark):
    right = spark.range(5).select(F.col("id").cast("string").alias("k"))
    plan = skew.lookup_join(skewed(spark), right, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_order_facts_with_a_hot_order(spark, tiny_limits):
    lines = skewed(spark).select(
        F.lit("R1").alias("report_id"), F.coalesce("k", F.lit("")).alias("order_key"), F.col("id").alias("line_no"),
        F.when(F.col("id") >= 10, F.lit("2026-01-01").cast("timestamp_ntz")).alias("order_ts"),
        F.lit(1.0).alias("buyer_paid"),
    )
    got = with_order_facts(lines)
    assert got.count() == 3000
    hot = got.filter("order_key = 'hot'")
    assert hot.agg(F.sum("paid_ratio")).first()[0] == pytest.approx(1)
    assert [r.line_no for r in hot.filter("ship_fee > 0").collect()] == [12]
    orders = got.select("order_key").distinct().count()
    assert got.filter("ship_fee > 0").count() == orders


def ranked(spark):
    """Rows in an order with ties and NULLs in both sort columns."""
    rows = spark.range(1000, numPartitions=5).select(
        F.when(F.col("id") % 11 != 0, F.col("id") * 7 % 10).alias("a"),
        F.when(F.col("id") % 9 != 0, F.timestamp_seconds(F.col("id")).cast("timestamp_ntz")).alias("b"), "id",
    )
    return rows, ["b", "id"]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_all_ways_of_paging_give_the_whole_order(spark, tmp_path, direction):
    rows, ties = ranked(spark)
    order = paging.sort_columns("a", direction, ties)
    whole = [r.id for r in rows.orderBy(*order).collect()]
    by_number = [r.id for n in range(1, 10) for r in paging.page(rows, order, n, 130).collect()]
    path = str(tmp_path / "pages")
    paging.write_numbered(rows, order, path)
    by_copy = [r.id for n in range(1, 10) for r in paging.stored_page(spark, path, n, 130).collect()]
    found = paging.page(rows, order, 1, 130).collect()
    by_key = []
    while found:
        by_key += [r.id for r in found]
        found = paging.rows_after(rows, "a", direction, ties, found[-1], 130).collect()
    assert by_number == whole and by_copy == whole and by_key == whole
    assert paging.page_count(0) == 1 and paging.page_count(31) == 3


def test_building_a_page_starts_no_job(spark, tmp_path):
    rows, ties = ranked(spark)
    order = paging.sort_columns("a", "asc", ties)
    path = str(tmp_path / "pages")
    paging.write_numbered(rows.select("a", "b", "id"), order, path)
    known = paging.numbered(spark, path).schema  # listing the files of a new folder is Spark's own
    spark.sparkContext.setJobGroup("paging", "pages")
    paging.page(rows, order, 700, 15)
    paging.rows_after(rows, "a", "asc", ties, {"a": 3, "b": None, "id": 9}, 15)
    ran = spark.sparkContext.statusTracker().getJobIdsForGroup("paging")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(ran) and "row_number" in known.names


def test_numbering_reads_every_row_once(spark, tmp_path):
    path = str(tmp_path / "numbered")
    paging.write_numbered(spark.range(500, numPartitions=4), [F.col("id").desc()], path)
    got = sorted((r.row_number, r.id) for r in paging.numbered(spark, path).collect())
    assert got == [(n, 499 - n) for n in range(500)]


def order_lines(spark, n=600):
    """Half of the lines has one order and one variant."""
    hot = F.col("id") % 2 == 0
    return spark.range(n).select(
        F.concat(F.lit("R"), F.col("id") % 3).alias("report_id"), F.col("id").alias("line_no"),
        F.when(hot, "hot").otherwise(F.col("id").cast("string")).alias("order_id"),
        F.when(hot, "P1-1").otherwise(F.concat(F.lit("P"), F.col("id") % 7 + 2, F.lit("-1"))).alias("sku_variant"),
        F.lit(1.0).alias("net_qty"), F.lit(10.0).alias("list_price"), F.lit(S.STATE_COMPLETED).alias("line_state"),
        F.lit(0.5).alias("paid_ratio"), F.lit(10.0).alias("gross_sales"), F.lit(0.0).alias("returned_qty"),
    )


def side_inputs(spark):
    combo = frame(spark, "combo_sku string, sub_sku string, ratio double, slot int", ("P1-1", "Q1-1", 0.5, 1), ("P1-1", "Q2-1", 0.5, 2))
    cashflow = frame(spark, "order_id string, aff_fee double", ("hot", 4.0), ("3", 2.0))
    master = frame(
        spark, "sku string, item_group string, product_type string, warehouse_type string, unit_cost double",
        ("P2", "a", "b", "c", 3.0), ("Q2", "a", "b", "c", 5.0),
    )
    return combo, cashflow, master


def test_sketches_of_reports_name_the_hot_keys(spark):
    kept = order_keys(order_lines(spark))
    assert kept.count() == 3
    assert [r.order_id for r in skew.sketched_keys(kept, "order_id", 100).collect()] == ["hot"]
    assert [r.sku for r in skew.sketched_keys(kept, "sku", 100).collect()] == ["P1"]
    assert skew.sketched_keys(kept, "order_id", 300).collect() == []
    parts = Sources(order_lines(spark), side_inputs(spark)[0], keys=kept).hot_skus(order_lines(spark))
    skew.HOT_ROWS, before = 100, skew.HOT_ROWS
    try:
        assert sorted(r.sku for r in parts().collect()) == ["P1", "Q1", "Q2"]
    finally:
        skew.HOT_ROWS = before


def test_lines_are_scanned_once_without_broadcasts(spark, tiny_limits, tmp_path):
    """All three joins past the broadcast limit, half of the lines on one key: the hot keys come from the sketches."""
    for name, table in (("orders", order_lines(spark)), ("keys", order_keys(order_lines(spark)))):
        table.write.parquet(str(tmp_path / name))
    orders, keys = (spark.read.parquet(str(tmp_path / name)) for name in ("orders", "keys"))

    def kpis(keys):
        return Dashboard(Sources(orders, *side_inputs(spark), keys=keys)).kpis()

    def scans(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return sum("line_no" in line or "order_id" in line for line in plan.splitlines() if "Relation [" in line and "gross_sales" in line)

    assert scans(kpis(keys)) == 1 < scans(kpis(None))
    assert kpis(keys).collect() == kpis(None).collect()


def test_ready_reports_prune_partitions(spark, tmp_path):
    order_lines(spark).write.partitionBy("report_id").parquet(str(tmp_path / "orders"))
    order_lines(spark).select("report_id", "order_id", F.lit(1.0).alias("aff_fee")).write.partitionBy("report_id").parquet(str(tmp_path / "fees"))
    manifest = frame(
        spark, "report_id string, kind string, status string, stored boolean",
        ("R1", "orders", "ready", True), ("R2", "orders", "processing", True), ("R0", "orders", "ready", False), ("R2", "cashflow", "ready", True),
    )
    board = Dashboard(Sources(spark.read.parquet(str(tmp_path / "orders")), cashflow=spark.read.parquet(str(tmp_path / "fees"))), manifest)
    lines = board.lines(columns=["line_no", "aff_fee"])
    assert lines.count() == 200
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "= R1)" in plan and "= R2)" in plan and "PartitionFilters: [isnotnull(report_id" in plan


def test_fees_by_order_join_without_a_shuffle(spark, tmp_path):
    """Also for a session that has not written the tables; lines without an id stay out of the join, spread as they come."""
    named = F.when(F.col("line_no") % 3 != 0, F.col("order_id"))
    lines = order_lines(spark, 900).withColumn("order_id", named.otherwise(F.when(F.col("line_no") % 2 == 0, "")))
    fees = frame(spark, "order_id string, aff_fee double", ("hot", 4.0), ("hot", 1.0), ("7", 2.0), ("absent", 9.0), ("", 5.0))
    root = str(tmp_path / "by-order")
    write_by_order(lines, fees, root, buckets=4)
    for forget in (False, True):
        if forget:
            for t in spark.catalog.listTables():
                if t.name.startswith("by_order_"):
                    spark.sql(f"DROP TABLE {t.name}")
        got = read_with_fees(spark, root, ["line_no", "order_id"])
        rows = {r.line_no: r.order_aff_fee for r in got.collect()}
        assert len(rows) == 900
        assert {r.line_no: {"hot": 5.0, "7": 2.0}.get(r.order_id, 0.0) if r.order_id else 0.0 for r in lines.collect()} == rows
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_totals_of_several_keys_from_one_scan(spark, tmp_path):
    order_lines(spark).write.parquet(str(tmp_path / "orders"))
    board = Dashboard(Sources(spark.read.parquet(str(tmp_path / "orders"))))
    got = board.group_totals(["sku", "order_id", "status"])
    assert {r.group_key: r.total for r in got.collect()} == {k: board.group_total(k).first().total for k in ("sku", "order_id", "status")}
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1


def test_order_facts_are_kept(spark, tiny_limits):
    """Hot orders and the join read the facts of orders where they were written, not the lines again."""
    lines = skewed(spark).select(
        F.lit("R1").alias("report_id"), F.coalesce("k", F.lit("")).alias("order_key"), F.col("id").alias("line_no"),
        F.lit("2026-01-01").cast("timestamp_ntz").alias("order_ts"), F.lit(1.0).alias("buyer_paid"),
    )
    got = with_order_facts(lines)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 3000") == 1 and any("order-facts" in f for f in got.inputFiles())
    assert got.count() == 3000


def test_order_facts_in_place_move_no_line(spark, tiny_limits):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        i = F.col("id")
        order_key = F.when(i % 5 == 0, "").otherwise((i % 40).cast("string"))
        orders = spark.range(40).select(F.col("id").alias("number"), (F.col("id") % 2).cast("string").alias("report_id"))
        lines = spark.range(1000).select(
            (i % 40).alias("number"), i.alias("line_no"), order_key.alias("order_key"),
            F.when(i % 7 != 0, F.lit("2026-01-01").cast("timestamp_ntz")).alias("order_ts"),
            F.when(i % 3 != 0, i.cast("double")).alias("buyer_paid"),
        ).join(orders, "number")
        got = with_order_facts(lines, dealt_by="number")
        want = with_order_facts(lines)
        shown = ["report_id", "line_no", "paid_ratio", "ship_fee"]
        assert sorted(got.select(shown).collect()) == sorted(want.select(shown).collect())
        # The windows need no other exchange than the join's two; the nameless lines go on their own.
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(number") == 4 and plan.count("hashpartitioning(report_id") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_bucket_by_order_stays_short_for_one_task(spark, tmp_path):
    lines = spark.range(1_200_000).select(F.lit("R1").alias("report_id"), F.col("id").alias("line_no"), (F.col("id") % 300_000).cast("string").alias("order_id"))
    fees = spark.range(100).select(F.col("id").cast("string").alias("order_id"), F.lit(1.0).alias("aff_fee"))
    write_by_order(lines, fees, str(tmp_path / "by-order"))
    assert {r.buckets for r in spark.read.parquet(str(tmp_path / "by-order/layout")).collect()} == {3}
    got = read_with_fees(spark, str(tmp_path / "by-order"), ["line_no"])
    assert got.count() == 1_200_000 and got.agg(F.sum("order_aff_fee")).first()[0] == 400


def test_dealt_lines_are_written_where_they_lie(spark, tmp_path):
    lines = spark.range(4000).select(F.concat(F.lit("R"), F.col("id") % 2).alias("report_id"), F.col("id").alias("line_no"))
    files = {}
    for dealt in (True, False):
        path = tmp_path / str(dealt)
        reports.write_reports(lines.repartition(4, "line_no"), str(path), dealt)
        files[dealt] = [len(list((path / f"report_id={r}").glob("part-*"))) for r in ("R0", "R1")]
        back = reports.read_reports(spark, str(path))
        assert back.count() == 4000 == back.select("report_id", "line_no").distinct().count()
    assert files == {True: [4, 4], False: [1, 1]}


@pytest.mark.parametrize(("limit", "dealt"), [(0, True), (1 << 40, False)])
def test_only_a_large_table_is_stored_as_the_join_has_dealt_it(spark, monkeypatch, limit, dealt):
    class Seen(Exception):
        pass

    def first(table, path, dealt):
        raise Seen(dealt)

    monkeypatch.setattr(skew, "BROADCAST_MAX_BYTES", limit)
    monkeypatch.setattr(star_schema, "write_reports", first)
    with pytest.raises(Seen, match=str(dealt)):
        star_schema.Star(spark, "/root/testdata/sf0.001").store("unused")


def written_parts(spark, folder, parts):
    """Tables of a star schema: parts of few names and types, 4,000 orders with two lines each."""
    ids = spark.range(parts).select(F.col("id").alias("p_partkey"), F.lit("bolt").alias("p_name"), F.lit("steel").alias("p_type"))
    ids.coalesce(1).write.parquet(f"{folder}/part.parquet")
    customers = spark.range(50).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"))
    orders = spark.range(4000).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 60).alias("o_custkey"), F.lit(100.0).alias("o_totalprice"), F.lit("F").alias("o_orderstatus"),
        F.lit("1996-05-01").cast("timestamp_ntz").alias("o_orderdate"),
    )
    lines = spark.range(8000).select(
        F.expr("id div 2").alias("l_orderkey"), (F.col("id") * 7 % (parts + 9)).alias("l_partkey"), (F.col("id") % 5).alias("l_suppkey"),
        (F.col("id") % 2 + 1).cast("int").alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.lit(20.0).alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"), F.lit("N").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
    )
    for name, table in (("customer", customers), ("orders", orders), ("lineitem", lines)):
        table.write.parquet(f"{folder}/{name}.parquet")


def test_many_parts_in_a_small_file_are_not_broadcast(spark, tmp_path):
    written_parts(spark, str(tmp_path), 1_000_000)
    size = sum(f.stat().st_size for f in (tmp_path / "part.parquet").glob("*.parquet"))
    assert size < 12e6  # in memory more than ten times as much
    star = star_schema.Star(spark, str(tmp_path))
    lines = star.typed_lines(["line_no", "product", "customer"])
    assert "_salt" in lines._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count() == 8000
    assert {(r.product, r["count"]) for r in lines.groupBy("product").count().collect()} == {("bolt", 8000)}
    assert lines.filter(F.col("customer") == S.UNKNOWN).count() == 1320


@pytest.mark.parametrize("limit", [0, 1 << 40])
def test_lines_are_dealt_by_order_whatever_the_size_of_the_parts(spark, monkeypatch, tmp_path, limit):
    written_parts(spark, str(tmp_path), 300)
    monkeypatch.setattr(skew, "BROADCAST_MAX_BYTES", limit)
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        star = star_schema.Star(spark, str(tmp_path))
        lines = star.joined(["product", "customer"])
        shuffles = [t._jdf.queryExecution().executedPlan().toString().count("Exchange hash") for t in (lines, lines.groupBy("l_orderkey").count())]
        assert shuffles[0] == shuffles[1] > 0
        got = sorted(map(str, lines.select("l_orderkey", "l_linenumber", "p_name", "c_name", "o_custkey").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = star.table("lineitem").join(star.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    plain = plain.join(star.table("part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(star.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    assert got == sorted(map(str, plain.select("l_orderkey", "l_linenumber", "p_name", "c_name", "o_custkey").collect()))
    assert len(got) == 8000


def test_frequent_keys_keep_their_type(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    rows = spark.range(400).select(F.when(F.col("id") % 4 == 0, F.col("id") % 3).when(F.col("id") % 4 != 1, F.lit(7)).cast("long").alias("k"))
    found = skew.frequent_keys(rows, "k")
    assert found.schema["k"].dataType == rows.schema["k"].dataType
    assert [r.k for r in found.collect()] == [7]
