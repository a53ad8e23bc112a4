import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketlens.operators import convert, mapping  # noqa: E402
from marketlens.session import tune  # noqa: E402
from marketlens.sources import sheets  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


def frame(spark, schema, *rows):
    """A small DataFrame whose size Spark knows (a local relation)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), struct)


_TYPES = {
    str: T.StringType(), int: T.DoubleType(), float: T.DoubleType(),
    dt.datetime: T.TimestampNTZType(), bool: T.BooleanType(),
}


def make_sheet(spark, headers, rows, report_id="R1"):
    """A sheet with the type of each column taken from its first filled cell."""
    fields = []
    for i, h in enumerate(headers):
        kind = next((type(r[i]) for r in rows if r[i] is not None), str)
        fields.append(T.StructField(h, _TYPES[kind]))
    fixed = [
        tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rows
    ]
    numbered = [(report_id, n, *r) for n, r in enumerate(fixed)]
    schema = T.StructType([T.StructField("report_id", T.StringType()), T.StructField("line_no", T.LongType()), *fields])
    return sheets.clean_sheet(frame(spark, schema, *numbered))


def convert_sheet(spark, headers, rows, kind="orders", report_id="R1"):
    sheet = make_sheet(spark, headers, rows, report_id)
    names = sheets.headers_of(sheet)
    detect = getattr(mapping, f"map_{kind}")
    return convert.CONVERTERS[kind](sheet, names, detect(names))


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


BASE_HEADERS = [
    "Mã đơn hàng", "Ngày đặt hàng", "Trạng Thái Đơn Hàng", "Lý do hủy", "SKU phân loại hàng", "Tên sản phẩm",
    "Tên phân loại hàng", "Giá gốc", "Giá ưu đãi", "Số lượng", "Số lượng sản phẩm được hoàn trả",
]
# One line per state.
BASE_ROWS = [
    ["K11", "2026-03-11 08:15", "Đã hủy", "Giao hàng thất bại", "NL07-2", "Nón len", "Nón", 45000, 2, 4, 0],
    ["K12", "2026-03-12 17:40", "Đã hủy", "Đặt nhầm màu", "UM31-1", "Ủng mưa", "Giày dép", 70000, 2, 2, 0],
    ["K13", "2026-03-13 06:05", "Hoàn thành", "", "NA12-5", "Nón lá", "Nón", 25000, 2, 3, 3],
    ["K14", "2026-03-14 21:30", "Hoàn thành", "", "DQ44-2", "Dép quai", "Giày dép", 36000, 2, 6, 1],
    ["K15", "2026-03-15 10:10", "Hoàn thành", "", "NC90-1", "Nón cối", "Nón", 310000, 2, 1, 0],
    ["K16", "2026-03-16 14:55", "Đang giao hàng", "", "GV28-3", "Giày vải", "Giày dép", 95000, 2, 2, 0],
]
MONEY_HEADERS = [
    *BASE_HEADERS, "Người bán trợ giá", "Mã giảm giá của Shop", "Số tiền người mua thanh toán",
    "Phí cố định", "Phí dịch vụ", "Phí xử lý giao dịch",
]
# One order of three lines, paid 25 / 50 / 25.
SPLIT_ROWS = [
    ["P5", "2026-03-20 09:09", "Hoàn thành", "", "GH52-1", "Ghế", "Nội thất", 80000, 2, 2, 0, 3200, 20000, 250000, 0, 0, 0],
    ["P5", "2026-03-20 09:09", "Hoàn thành", "", "TR18-4", "Tranh", "Trang trí", 210000, 2, 1, 0, 2500, 20000, 500000, 0, 0, 0],
    ["P5", "2026-03-20 09:09", "Hoàn thành", "", "VI09-1", "Ví", "Phụ kiện", 60000, 2, 3, 0, 700, 20000, 250000, 0, 0, 0],
]


@pytest.fixture(scope="session")
def base_orders(spark):
    return convert_sheet(spark, BASE_HEADERS, BASE_ROWS).cache()


@pytest.fixture(scope="session")
def split_orders(spark):
    return convert_sheet(spark, MONEY_HEADERS, SPLIT_ROWS).cache()


def eval_on(spark, values, build, kind="string"):
    """Values of `build(column)` for each input, in order."""
    df = frame(spark, f"i int, v {kind}", *enumerate(values))
    return [r["out"] for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]
