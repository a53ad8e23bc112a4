"""Table schemas, fixed vocabulary and column lists shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Line states, in the business order used to display them.
# ---------------------------------------------------------------------------
STATE_COMPLETED = "Hoàn thành"
STATE_DELIVERING = "Đang giao"
STATE_PARTLY_RETURNED = "Hoàn 1 phần"
STATE_RETURNED = "Hoàn hàng"
STATE_CANCELLED_BEFORE = "Hủy chưa XK"
STATE_CANCELLED_AFTER = "Hủy sau XK"

STATE_ORDER = [
    STATE_COMPLETED,
    STATE_DELIVERING,
    STATE_PARTLY_RETURNED,
    STATE_RETURNED,
    STATE_CANCELLED_BEFORE,
    STATE_CANCELLED_AFTER,
]
GMV_STATES = [STATE_COMPLETED, STATE_DELIVERING, STATE_PARTLY_RETURNED]

# Marker texts searched in accent-free status and reason texts.
CANCEL_MARK = "huy"
DELIVERY_FAILED_MARK = "giao hang that bai"
COMPLETED_MARK = "hoan thanh"

# Default label, label of combo children, flat fee per order.
UNKNOWN = "(Không rõ)"
COMBO_LABEL = "combo"
SHIP_FEE_PER_ORDER = 1620.0

# ---------------------------------------------------------------------------
# Header keywords per field and report kind (normalised text).
# ---------------------------------------------------------------------------
ORDER_KEYWORDS = {
    "order_ts": ["ngay dat hang", "ngay ban", "ngay giao dich", "order date", "ngay", "date", "thoi gian"],
    "product": ["ten san pham", "ten mat hang", "ten hang", "san pham", "mat hang", "product", "item"],
    "category": [
        "ten phan loai hang", "danh muc san pham", "danh muc", "phan loai hang", "phan loai", "loai", "nhom",
        "category",
    ],
    "customer": ["ten khach hang", "khach hang", "khach", "customer"],
    "qty": ["so luong san pham", "so luong", "qty", "quantity", "sl"],
    "price": ["gia uu dai", "don gia", "gia ban", "gia", "price", "unit price"],
    "revenue": [
        "tong gia tri don hang", "tong so tien thanh toan", "doanh thu", "thanh tien", "tong tien",
        "gia tri don hang", "thanh toan", "revenue", "total", "amount", "gia tri",
    ],
    "raw_status": ["trang thai don hang", "trang thai", "status"],
    "order_id": ["ma don hang"],
    "sku_variant": ["sku phan loai hang", "sku phan loai"],
    "list_price": ["gia goc"],
    "cancel_reason": ["ly do huy"],
    "returned_qty": ["so luong san pham duoc hoan tra", "so luong hoan tra", "sl hoan tra"],
    "seller_subsidy": ["nguoi ban tro gia"],
    "shop_voucher": ["ma giam gia cua shop", "ma giam gia shop"],
    "buyer_paid": ["so tien nguoi mua thanh toan"],
    "fixed_fee": ["phi co dinh"],
    "service_fee": ["phi dich vu"],
    "transaction_fee": ["phi xu ly giao dich"],
}
COMBO_KEYWORDS = {
    "combo_sku": ["sku combo"],
    "sku1": ["sku1"],
    "sku2": ["sku2"],
    "sku3": ["sku3"],
    "ratio1": ["ti le sku 1"],
    "ratio2": ["ti le sku 2"],
    "ratio3": ["ti le sku 3"],
}
MASTER_KEYWORDS = {
    "sku": ["sku"],
    "warehouse_type": ["phan loai kho onl", "phan loai kho"],
    "item_group": ["muc"],
    "product_type": ["phan loai sp"],
    "unit_cost": ["gia von"],
}
CASHFLOW_KEYWORDS = {
    "order_id": ["ma don hang"],
    "aff_fee": ["phi hoa hong tiep thi lien ket"],
}
ADJUSTMENT_KEYWORDS = {
    "transaction_id": ["ma giao dich"],
    "adjustment_date": ["dieu chinh don hang"],
    "adjustment_type": ["loai dieu chinh"],
    "reason": ["ly do dieu chinh"],
    "amount": ["so tien dieu chinh"],
    "related_order_id": ["ma don hang lien quan"],
    "payment_completed_date": ["hoan thanh thanh toan"],
}
# Fields that must not be taken from an identifier column, and
# the words such a column starts with.
NAME_LIKE_FIELDS = ["product", "category", "customer"]
IDENTIFIER_PREFIX = r"^(sku|ma|id)\b"
IDENTIFIER_PENALTY = 50
EXACT_MATCH_BONUS = 100

# ---------------------------------------------------------------------------
# Stored tables. `report_id` and `line_no` say where a line came from.
# ---------------------------------------------------------------------------


def _schema(strings=(), doubles=(), head=(), tail=()):
    fields = [T.StructField(n, t) for n, t in head]
    fields += [T.StructField(n, T.StringType()) for n in strings]
    fields += [T.StructField(n, T.DoubleType()) for n in doubles]
    fields += [T.StructField(n, t) for n, t in tail]
    return T.StructType(fields)


_REPORT = [("report_id", T.StringType())]
_REPORT_LINE = _REPORT + [("line_no", T.LongType())]

ORDERS_SCHEMA = _schema(
    head=_REPORT_LINE + [("order_ts", T.TimestampNTZType())],
    strings=["order_id", "sku_variant", "product", "category", "customer", "raw_status", "line_state"],
    doubles=[
        "qty", "returned_qty", "net_qty", "price", "list_price", "revenue", "gross_sales",
        "discount", "voucher", "platform_fee", "ship_fee", "paid_ratio",
    ],
)
COMBO_SCHEMA = _schema(
    head=_REPORT, strings=["combo_sku", "sub_sku"], doubles=["ratio"], tail=[("slot", T.IntegerType())]
)
MASTER_SCHEMA = _schema(
    head=_REPORT, strings=["sku", "item_group", "product_type", "warehouse_type"], doubles=["unit_cost"]
)
CASHFLOW_SCHEMA = _schema(head=_REPORT, strings=["order_id"], doubles=["aff_fee"])
ADJUSTMENT_SCHEMA = _schema(
    head=_REPORT_LINE,
    strings=[
        "transaction_id", "adjustment_date", "adjustment_type", "reason", "related_order_id",
        "payment_completed_date",
    ],
    doubles=["amount"],
)

# Columns a converted report may lack because it predates them; they read as 0.
OPTIONAL_ORDER_COLUMNS = ["discount", "voucher", "platform_fee", "ship_fee", "paid_ratio"]

# ---------------------------------------------------------------------------
# Enriched lines: output columns in display order, sort and group keys.
# ---------------------------------------------------------------------------
DETAIL_COLUMNS = [
    "order_ts", "order_id", "sku", "sku_variant", "product", "category", "customer",
    "qty", "returned_qty", "net_qty", "price", "list_price", "revenue", "gross_sales",
    "raw_status", "line_state", "discount", "voucher", "platform_fee", "ship_fee", "aff_fee",
    "warehouse_type", "item_group", "product_type", "cost", "gmv", "net_revenue", "nmv",
    "gross_profit", "sales_channel",
]
# Identify one enriched line; carried for stable paging, not shown.
LINE_KEY = ["report_id", "line_no", "slot", "sku_variant"]

DETAIL_SORT_COLUMNS = [
    "order_ts", "order_id", "product", "category", "customer", "qty", "gross_sales", "line_state",
    "gmv", "net_revenue", "nmv", "gross_profit",
]

# Group-by key of the API -> enriched column.
GROUP_KEYS = {
    "sku": "sku",
    "product": "product",
    "category": "category",
    "customer": "customer",
    "status": "line_state",
    "warehouse_type": "warehouse_type",
    "item_group": "item_group",
    "product_type": "product_type",
    "order_id": "order_id",
    "sales_channel": "sales_channel",
}
GROUP_SUMS = [
    "qty", "returned_qty", "net_qty", "gross_sales", "discount", "voucher", "platform_fee", "ship_fee",
    "aff_fee", "cost", "gmv", "net_revenue", "nmv", "gross_profit",
]
GROUP_SORT_COLUMNS = ["group_value", "row_count", *GROUP_SUMS]

# Facet name -> enriched column; only the first two keep blank values.
FACETS = {
    "categories": "category",
    "statuses": "line_state",
    "warehouse_types": "warehouse_type",
    "item_groups": "item_group",
    "product_types": "product_type",
    "sales_channels": "sales_channel",
}
FACETS_KEEPING_BLANK = ["categories", "statuses"]

# Display labels of exported columns.
DETAIL_LABELS = {
    "order_ts": "Ngày", "order_id": "Mã đơn hàng", "sku": "SKU", "sku_variant": "SKU phân loại",
    "product": "Sản phẩm", "category": "Danh mục", "customer": "Khách hàng",
    "qty": "Số lượng", "returned_qty": "SL hoàn trả", "net_qty": "SL thực",
    "price": "Giá bán", "list_price": "Giá gốc", "revenue": "Doanh thu", "gross_sales": "Doanh số",
    "raw_status": "Status", "line_state": "Trạng thái", "discount": "Giảm giá", "voucher": "Voucher",
    "platform_fee": "Phí sàn", "ship_fee": "Phí Piship", "aff_fee": "Phí AFF",
    "warehouse_type": "Phân loại kho", "item_group": "Phân loại mục", "product_type": "Phân loại sản phẩm",
    "cost": "Giá vốn", "gmv": "GMV", "net_revenue": "Doanh thu thuần", "nmv": "NMV",
    "gross_profit": "Lợi nhuận gộp", "sales_channel": "Kênh bán hàng",
}
GROUP_LABELS = {
    "sku": "SKU", "product": "Sản phẩm", "category": "Danh mục", "customer": "Khách hàng",
    "status": "Trạng thái", "warehouse_type": "Phân loại kho", "item_group": "Phân loại mục",
    "product_type": "Phân loại sản phẩm", "order_id": "Mã đơn hàng", "sales_channel": "Kênh bán hàng",
}
ROW_COUNT_LABEL = "Số dòng"
