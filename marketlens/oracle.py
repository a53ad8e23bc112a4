"""The same questions as `catalog`, as SQL for an independent engine.

Written from the rules, not from the plans: windows instead of aggregate-and-
join, clean values instead of parsed text wherever possible.
"""

from __future__ import annotations

from marketlens import schemas as S
from marketlens.adapters import star_schema as A
from marketlens.catalog import DATE_FROM, DATE_TO
from marketlens.functions.dates import PRESETS

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------------------
# Small text builders
# ---------------------------------------------------------------------------


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def money(expr: str, digits: int = 2) -> str:
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38, 6)), {digits}) AS DOUBLE)"


def exact(expr: str) -> str:
    """A sum that does not depend on the order of the rows."""
    return f"coalesce(sum(TRY_CAST(({expr}) AS DECIMAL(38, 10))), 0)::DOUBLE"


def ratio(expr: str) -> str:
    return money(expr, 6)


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def date(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


_AMOUNTS = {
    *(f.name for f in S.ORDERS_SCHEMA.fields if f.dataType.typeName() == "double"), *S.GROUP_SUMS,
    "ratio", "unit_cost", "amount", "line_aff_fee", "scoped_discount", "scoped_voucher",
}


def shown(*columns: str) -> str:
    """Select list with amounts rounded and timestamps as text."""
    out = []
    for c in columns:
        if c in ("paid_ratio", "ratio"):
            out.append(f"{ratio(c)} AS {c}")
        elif c in _AMOUNTS:
            out.append(f"{money(c)} AS {c}")
        elif c == "order_ts":
            out.append(f"{day(c)} AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


GMV = in_list(S.GMV_STATES)

# ---------------------------------------------------------------------------
# Shared table expressions, each with the ones it builds on
# ---------------------------------------------------------------------------
LINE_NO = "(l_orderkey * 10 + l_linenumber) * 1000000 + (l_partkey * 31 + l_suppkey) % 1000000"
BAD_DATE = f"(l_orderkey % {A.BAD_DATE_EVERY} = 0 AND l_linenumber = 1)"
BLANK_ID = f"l_orderkey % {A.BLANK_ID_EVERY} = 0"
RETURNED = """CASE WHEN l_returnflag <> 'R' THEN 0.0::DOUBLE WHEN l_linenumber % 2 = 1 THEN l_quantity
        ELSE floor(l_quantity / 2) END"""
STATUS = "CASE WHEN l_returnflag = 'A' THEN 'Đã hủy' WHEN o_orderstatus = 'F' THEN 'Hoàn thành' ELSE 'Đang giao hàng' END"
STATE = f"""CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN {lit(S.STATE_CANCELLED_AFTER)}
        WHEN l_returnflag = 'A' THEN {lit(S.STATE_CANCELLED_BEFORE)}
        WHEN l_quantity = ({RETURNED}) THEN {lit(S.STATE_RETURNED)}
        WHEN ({RETURNED}) > 0 THEN {lit(S.STATE_PARTLY_RETURNED)}
        WHEN o_orderstatus = 'F' THEN {lit(S.STATE_COMPLETED)}
        ELSE {lit(S.STATE_DELIVERING)} END"""
STAR = """lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
      LEFT JOIN part ON l_partkey = p_partkey"""

TABLES = {
    "star": f"SELECT *, year(o_orderdate) AS y FROM {STAR}",
    # Typed lines, undated ones too.
    "typed": f"""
      SELECT 'R' || y AS report_id, {LINE_NO} AS line_no,
        CASE WHEN {BAD_DATE} THEN NULL ELSE o_orderdate END AS order_ts,
        CASE WHEN {BLANK_ID} THEN '' ELSE l_orderkey::VARCHAR END AS order_id,
        'P' || l_partkey || '-' || l_suppkey AS sku_variant,
        p_name AS product, p_type AS category, c_name AS customer,
        {STATUS} AS raw_status, {STATE} AS line_state,
        l_quantity AS qty, {RETURNED} AS returned_qty, l_quantity - ({RETURNED}) AS net_qty,
        l_extendedprice / l_quantity * (1 - l_discount) AS price, l_extendedprice / l_quantity AS list_price,
        CASE WHEN y % 2 = 0 THEN l_extendedprice * (1 - l_discount) END AS given_revenue,
        CASE WHEN y <> {A.OLD_YEAR} THEN l_extendedprice * (1 - l_discount) END AS paid,
        CASE WHEN y <> {A.OLD_YEAR} THEN l_extendedprice * l_discount ELSE 0 END AS subsidy,
        CASE WHEN y <> {A.OLD_YEAR} THEN o_totalprice * 0.01::DOUBLE ELSE 0 END AS order_voucher,
        CASE WHEN y <> {A.OLD_YEAR} THEN o_totalprice * 0.02::DOUBLE + o_totalprice * 0.01::DOUBLE
          + o_totalprice * 0.005::DOUBLE ELSE 0 END AS order_fees
      FROM star""",
    "facts": """
      SELECT *, sum(paid) OVER (PARTITION BY report_id, order_id) AS order_paid,
        min(CASE WHEN order_ts IS NOT NULL THEN line_no END) OVER (PARTITION BY report_id, order_id) AS first_line
      FROM typed""",
    # Stored order lines.
    "ord": f"""
      SELECT report_id, line_no, order_ts, order_id, sku_variant, product, category, customer, raw_status, line_state,
        qty, returned_qty, net_qty, price, list_price, coalesce(given_revenue, price * qty) AS revenue,
        list_price * qty AS gross_sales, subsidy / qty * net_qty AS discount,
        order_voucher * paid_ratio / qty * net_qty AS voucher, order_fees * paid_ratio AS platform_fee,
        CASE WHEN line_no = first_line THEN {S.SHIP_FEE_PER_ORDER}::DOUBLE ELSE 0 END AS ship_fee, paid_ratio
      FROM (SELECT *, CASE WHEN order_paid <> 0 THEN paid / order_paid ELSE 0 END AS paid_ratio FROM facts)
      WHERE order_ts IS NOT NULL""",
    # Of these the dashboard shows the ready reports.
    "ready": """
      SELECT * FROM ord WHERE report_id IN (SELECT report_id FROM reports WHERE status = 'ready' AND y <> 1998)""",
    "ready_combo": "SELECT * FROM combo WHERE regexp_extract(combo_sku, '[0-9]+$')::BIGINT % 4 <> 3",
    "variants": "SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_partkey % 10 = 0",
    "combo": """
      SELECT 'P' || p || '-' || s AS combo_sku, 'P' || (p + 1) || '-' || s AS sub_sku, 0.5::DOUBLE AS ratio, 1 AS slot
      FROM variants WHERE p % 70 <> 0
      UNION ALL SELECT 'P' || p || '-' || s, 'P' || (p + 2) || '-' || s,
        CASE WHEN p % 20 = 0 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END, 2 FROM variants
      UNION ALL SELECT 'P' || p || '-' || s, 'P' || (p + 3) || '-' || s, 0.2::DOUBLE, 3 FROM variants WHERE p % 20 = 0""",
    # The repeated rows of a SKU differ by a suffix and a dearer cost, so the smallest are the plain ones.
    "master": """
      SELECT 'P' || p_partkey AS sku, p_brand AS item_group, p_type AS product_type,
        'Kho ' || (p_size % 4) AS warehouse_type, p_retailprice AS unit_cost
      FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 6 <> 5""",
    "fees": """
      SELECT o_orderkey::VARCHAR AS order_id,
        floor(o_totalprice * 0.02::DOUBLE) + CASE WHEN o_orderkey % 9 = 1 THEN 500 ELSE 0 END AS order_aff_fee
      FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 4""",
    "reports": f"""
      SELECT DISTINCT 'R' || year(o_orderdate) AS report_id, year(o_orderdate) AS y,
        CASE WHEN year(o_orderdate) = {A.UNASSIGNED_YEAR} THEN ''
          WHEN year(o_orderdate) = {A.ORPHAN_YEAR} THEN ''
          ELSE (CASE year(o_orderdate) % 3 {" ".join(
              f"WHEN {int(k[1]) - 1} THEN {lit(v)}" for k, v in A.CHANNEL_NAMES.items())} END) END AS sales_channel,
        CASE WHEN year(o_orderdate) % 4 = 3 THEN 'processing' ELSE 'ready' END AS status
      FROM orders""",
    # Enriched lines with their key.
    "enr": f"""
      SELECT *, split_part(sku_variant, '-', 1) AS sku,
        gmv - scoped_discount - scoped_voucher AS net_revenue,
        gmv - scoped_discount - scoped_voucher - platform_fee - ship_fee - aff_fee AS nmv,
        gmv - scoped_discount - scoped_voucher - platform_fee - ship_fee - aff_fee
          - CASE WHEN line_state IN {GMV} THEN cost ELSE 0 END AS gross_profit
      FROM (
        SELECT o.report_id, o.line_no, c.slot, o.order_ts, o.order_id, coalesce(c.sub_sku, o.sku_variant) AS sku_variant,
          o.product, o.category, o.customer, o.qty, o.returned_qty, o.net_qty,
          o.price * coalesce(c.ratio, 1) AS price, o.list_price * coalesce(c.ratio, 1) AS list_price,
          o.revenue * coalesce(c.ratio, 1) AS revenue, o.gross_sales * coalesce(c.ratio, 1) AS gross_sales,
          o.raw_status, o.line_state, coalesce(c.ratio, 1) AS ratio,
          o.discount * coalesce(c.ratio, 1) AS discount, o.voucher * coalesce(c.ratio, 1) AS voucher,
          o.platform_fee * coalesce(c.ratio, 1) AS platform_fee,
          CASE WHEN (c.slot IS NULL OR c.slot = 1) AND o.line_state <> {lit(S.STATE_CANCELLED_BEFORE)}
            THEN o.ship_fee ELSE 0 END AS ship_fee,
          o.paid_ratio * coalesce(f.order_aff_fee, 0) * coalesce(c.ratio, 1) AS aff_fee,
          CASE WHEN c.slot IS NOT NULL THEN 'combo' ELSE coalesce(m.warehouse_type, '') END AS warehouse_type,
          CASE WHEN c.slot IS NOT NULL THEN 'combo' ELSE coalesce(m.item_group, '') END AS item_group,
          CASE WHEN c.slot IS NOT NULL THEN 'combo' ELSE coalesce(m.product_type, '') END AS product_type,
          o.net_qty * coalesce(m.unit_cost, 0) AS cost,
          CASE WHEN o.line_state IN {GMV} THEN o.list_price * coalesce(c.ratio, 1) * o.net_qty ELSE 0 END AS gmv,
          CASE WHEN o.line_state IN {GMV} THEN o.discount * coalesce(c.ratio, 1) ELSE 0 END AS scoped_discount,
          CASE WHEN o.line_state IN {GMV} THEN o.voucher * coalesce(c.ratio, 1) ELSE 0 END AS scoped_voucher,
          coalesce(r.sales_channel, '') AS sales_channel
        FROM ready o
        LEFT JOIN ready_combo c ON o.sku_variant = c.combo_sku
        LEFT JOIN fees f ON o.order_id = f.order_id
        LEFT JOIN master m ON split_part(coalesce(c.sub_sku, o.sku_variant), '-', 1) = m.sku
        LEFT JOIN reports r ON o.report_id = r.report_id
      )""",
}
USES = {
    "typed": ["star"],
    "facts": ["typed"],
    "ord": ["facts"],
    "combo": ["variants"],
    "ready": ["ord", "reports"],
    "ready_combo": ["combo"],
    "enr": ["ready", "ready_combo", "fees", "master", "reports"],
}


def sql(select: str, *tables: str, extra: dict[str, str] | None = None) -> str:
    """A statement with the shared tables it names and all they build on."""
    needed: list[str] = []

    def add(name):
        for below in USES.get(name, []):
            add(below)
        if name not in needed:
            needed.append(name)

    for name in tables:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({TABLES[n]})" for n in needed]
    parts += [f"{n} AS ({text})" for n, text in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + select


KEY = ("report_id", "line_no")
LINE = ("report_id", "line_no", "slot", "sku_variant")


def stored(name, *columns, where="TRUE"):
    ORACLE[name] = sql(f"SELECT {shown(*KEY, *columns)} FROM ord WHERE {where}", "ord")


def lines(name, *columns, where="TRUE"):
    ORACLE[name] = sql(f"SELECT {shown(*LINE, *columns)} FROM enr WHERE {where}", "enr")


# ---------------------------------------------------------------------------
# Sources, ingestion, sinks
# ---------------------------------------------------------------------------
_OLD = f"report_id = 'R{A.OLD_YEAR}'"
ORACLE["scan_union_by_name"] = sql(
    f"""SELECT report_id, line_no, {money('gross_sales')} AS gross_sales,
      CASE WHEN NOT {_OLD} THEN {money('discount')} END AS discount,
      CASE WHEN NOT {_OLD} THEN {ratio('paid_ratio')} END AS paid_ratio FROM ord""",
    "ord",
)
ORACLE["optional_columns"] = sql(
    "SELECT report_id, line_no, "
    + ", ".join(f"{money(f'CASE WHEN {_OLD} THEN 0 ELSE {c} END', 6 if c == 'paid_ratio' else 2)} AS {c}" for c in S.OPTIONAL_ORDER_COLUMNS)
    + " FROM ord",
    "ord",
)
ORACLE["raw_sheet_cleanup"] = f"""
SELECT 'C' || c_custkey AS report_id, c_custkey AS line_no,
  CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE '' END AS shop_name,
  CASE WHEN c_custkey % 7 <> 0 THEN {money('c_acctbal')} END AS balance, c_mktsegment AS segment
FROM customer"""


def layout_list(layouts) -> str:
    return "[" + ", ".join("[" + ", ".join(lit(h) for h in layout) + "]" for layout in layouts) + "]"


def shop_headers(layouts) -> str:
    """Uploads per customer: `report_id, header_pos, header`."""
    return f"""
      SELECT 'C' || c_custkey AS report_id, pos AS header_pos,
        CASE c_custkey % 3 WHEN 0 THEN upper(h[pos + 1]) WHEN 1 THEN h[pos + 1] || ' *' ELSE h[pos + 1] END AS header
      FROM (SELECT c_custkey, h, unnest(range(len(h))) AS pos
        FROM (SELECT c_custkey, ({layout_list(layouts)})[c_custkey % {len(layouts)} + 1] AS h FROM customer))"""


def norm(expr: str) -> str:
    bare = f"replace(lower(strip_accents({expr})), 'đ', 'd')"
    return f"trim(regexp_replace({bare}, '[^a-z0-9]+', ' ', 'g'))"


ORACLE["normalize_headers"] = f"""
WITH headers AS ({shop_headers([A.FULL_LAYOUT, A.OTHER_NAMES_LAYOUT])}),
texts AS (SELECT 'document' AS kind, doc_id::VARCHAR AS id, text AS header FROM documents
  UNION ALL SELECT 'header', report_id || '/' || header_pos, header FROM headers)
SELECT kind, id, md5({norm('header')}) AS norm_md5, length({norm('header')})::INT AS n FROM texts"""


def keyword_values(keywords) -> str:
    rows = [f"({lit(f)}, {lit(w)})" for f, words in keywords.items() for w in words]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") k(field, word)"


def scored(headers: str, keywords, penalised) -> dict[str, str]:
    penalty = "0"
    if penalised:
        penalty = (
            f"CASE WHEN field IN {in_list(penalised)} AND regexp_matches(n, '{S.IDENTIFIER_PREFIX}') "
            f"THEN {S.IDENTIFIER_PENALTY} ELSE 0 END"
        )
    return {
        "headers": headers,
        "normed": f"SELECT *, {norm('header')} AS n FROM headers",
        "words": keyword_values(keywords),
        "hits": f"""SELECT report_id, header_pos, header, field,
          (CASE WHEN n = word THEN {S.EXACT_MATCH_BONUS} ELSE 0 END + length(word) - {penalty})::INT AS score
          FROM normed JOIN words ON contains(n, word)""",
        "mapped": """SELECT report_id, field, header, score FROM hits WHERE score > 0
          QUALIFY row_number() OVER (PARTITION BY report_id, field ORDER BY score DESC, header_pos) = 1""",
    }


_SHOPS = [A.FULL_LAYOUT, A.OLD_LAYOUT, A.OTHER_NAMES_LAYOUT, A.NO_DATE_LAYOUT, A.IDS_ONLY_LAYOUT]
_SHOP_MAP = scored(shop_headers(_SHOPS), S.ORDER_KEYWORDS, S.NAME_LIKE_FIELDS)
ORACLE["schema_map_scored"] = sql("SELECT * FROM mapped", extra=_SHOP_MAP)
_COMBOS = scored(shop_headers([A.COMBO_LAYOUT, A.COMBO_LAYOUT[::-1], A.COMBO_LAYOUT[1:]]), S.COMBO_KEYWORDS, [])
_COMBOS["mapped"] = """SELECT DISTINCT report_id, field, header FROM hits
  QUALIFY header_pos = min(header_pos) OVER (PARTITION BY report_id, field)"""
ORACLE["schema_map_first_match"] = sql("SELECT * FROM mapped", extra=_COMBOS)
ORACLE["schema_map_override"] = sql(
    """SELECT report_id, field, header FROM mapped WHERE substr(report_id, 2)::BIGINT % 10 <> 0
    UNION ALL SELECT 'C' || c_custkey, field, header FROM customer, (VALUES ('order_ts', 'Ngày đặt hàng'),
      ('product', 'SKU phân loại hàng'), ('qty', 'Số lượng')) v(field, header) WHERE c_custkey % 10 = 0""",
    extra=_SHOP_MAP,
)
ORACLE["header_listing"] = f"SELECT report_id, header_pos::INT AS header_pos, header FROM ({shop_headers(_SHOPS)})"
ORACLE["report_validation"] = sql(
    f"""SELECT r.report_id, CASE WHEN r.y = 2001 THEN 'failed' ELSE 'ready' END AS status,
      CASE WHEN r.y <> 2001 THEN n END AS row_count, CASE WHEN r.y = 2001 THEN 'no_date_column' END AS error
    FROM reports r LEFT JOIN (SELECT y, count(*) AS n FROM star WHERE NOT {BAD_DATE} GROUP BY y) s ON r.y = s.y""",
    "reports", "star",
)


ORACLE["ingest_outcomes"] = sql(
    f"""SELECT r.report_id, 'don hang ' || r.y AS name, CASE WHEN r.y = 2001 THEN 'failed' ELSE 'ready' END AS status,
      r.y <> 2001 AS stored, CASE WHEN r.y <> 2001 THEN n END AS row_count,
      CASE WHEN r.y = 2001 THEN 'no_date_column' END AS error
    FROM reports r LEFT JOIN (SELECT y, count(*) AS n FROM star WHERE NOT {BAD_DATE} GROUP BY y) s ON r.y = s.y""",
    "reports", "star",
)


def grouped_digits(expr: str) -> str:
    return f"replace(format('{{:,}}', ({expr})::BIGINT), ',', '.')"


def parsed_number(cell: str) -> str:
    """The number rule without lookahead: split at the dots and look at what follows each."""
    kept = f"regexp_replace({cell}, '[^0-9.,-]', '', 'g')"
    parts = f"string_split({kept}, '.')"
    joined = (
        f"list_aggregate(list_transform({parts}, lambda x, i: CASE WHEN i = 1 THEN x "
        f"WHEN regexp_matches(x, '^[0-9]{{3}}([^0-9]|$)') THEN x ELSE '.' || x END), 'string_agg', '')"
    )
    return f"coalesce(TRY_CAST(replace({joined}, ',', '.') AS DOUBLE), 0)"


_WHOLE = "floor(l_extendedprice * 100)::BIGINT"
_CELL = f"""CASE l_orderkey % 8 WHEN 0 THEN {grouped_digits(_WHOLE)} || ' đ'
  WHEN 1 THEN l_quantity::INT || '.5' WHEN 2 THEN l_quantity::INT || ',75 VND'
  WHEN 3 THEN format('{{:,}}', {_WHOLE}) WHEN 4 THEN '-' || {grouped_digits(_WHOLE)}
  WHEN 5 THEN 'gia ' || l_partkey || '.' || l_suppkey || '.1234' WHEN 6 THEN ''
  ELSE l_linenumber || '.' || {_WHOLE} || '-' END"""
ORACLE["clean_numbers"] = f"""
WITH cells AS (SELECT {LINE_NO} AS line_no, {_CELL} AS cell FROM lineitem)
SELECT line_no, cell, {money(parsed_number('cell'), 6)} AS parsed FROM cells"""
ORACLE["clean_dates"] = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (0, 1, 2, 3, 4, 9) THEN {day('o_orderdate')}
    WHEN o_orderkey % 10 = 6 AND month(o_orderdate) IN (1, 3, 5, 7, 8, 10, 12)
      THEN {day("date_trunc('month', o_orderdate) + INTERVAL 30 DAY")} END AS from_text,
  {day("o_orderdate + INTERVAL 6 HOUR")} AS from_serial
FROM orders"""
ORACLE["drop_undated_rows"] = sql(f"SELECT {shown(*KEY, 'order_ts', 'qty')} FROM typed WHERE order_ts IS NOT NULL", "typed")
ORACLE["text_defaults"] = f"""
SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN {lit(S.UNKNOWN)} ELSE p_name END AS named,
  CASE WHEN p_partkey % 5 IN (0, 1) THEN '' ELSE p_name END AS plain
FROM part"""

# Orders as parsed from the uploaded sheets: amounts in whole units, per layout of the year.
_RAW = {
    "raw": f"""
      SELECT *, y IN (1997, 1999) AS other_names, y = {A.OLD_YEAR} AS is_old,
        'R' || y AS report_id, {LINE_NO} AS line_no, CASE WHEN {BLANK_ID} THEN '' ELSE l_orderkey::VARCHAR END AS order_id,
        {RETURNED} AS returned_qty, l_quantity - ({RETURNED}) AS net_qty, {STATE} AS line_state,
        floor(l_extendedprice / l_quantity * 100) AS list_price,
        floor(l_extendedprice / l_quantity * (1 - l_discount) * 100) AS price,
        floor(l_extendedprice * (1 - l_discount) * 100) AS paid
      FROM star WHERE y <> 2001""",
    "priced": f"""
      SELECT *, sum(paid) OVER (PARTITION BY report_id, order_id) AS order_paid,
        min(CASE WHEN NOT {BAD_DATE} THEN line_no END) OVER (PARTITION BY report_id, order_id) AS first_line FROM raw""",
    "shares": """
      SELECT *, CASE WHEN is_old OR order_paid = 0 THEN 0 ELSE paid / order_paid END AS paid_ratio FROM priced""",
    "converted": f"""
      SELECT report_id, line_no, o_orderdate AS order_ts, order_id, 'P' || l_partkey || '-' || l_suppkey AS sku_variant,
        p_name AS product, CASE WHEN l_partkey % 37 = 0 THEN {lit(S.UNKNOWN)} ELSE p_type END AS category,
        c_name AS customer, {STATUS} AS raw_status, line_state, l_quantity AS qty, returned_qty, net_qty, price, list_price,
        CASE WHEN is_old THEN price * l_quantity WHEN other_names THEN paid ELSE paid + 1000 END AS revenue,
        list_price * l_quantity AS gross_sales,
        CASE WHEN is_old THEN 0 ELSE floor(l_extendedprice * l_discount * 100) / l_quantity * net_qty END AS discount,
        CASE WHEN is_old THEN 0 ELSE floor(o_totalprice) * paid_ratio / l_quantity * net_qty END AS voucher,
        CASE WHEN is_old THEN 0 ELSE (floor(o_totalprice * 2) + floor(o_totalprice) + floor(o_totalprice * 0.5::DOUBLE))
          * paid_ratio END AS platform_fee,
        CASE WHEN line_no = first_line THEN {S.SHIP_FEE_PER_ORDER}::DOUBLE ELSE 0 END AS ship_fee, paid_ratio
      FROM shares WHERE NOT {BAD_DATE}""",
}
_CONVERTED = sql(f"SELECT {shown(*S.ORDERS_SCHEMA.names)} FROM converted", "star", extra=_RAW)
ORACLE["convert_orders"] = _CONVERTED
ORACLE["incremental_ingest"] = _CONVERTED
ORACLE["convert_combo"] = sql(
    f"""SELECT 'K' || s % 5 AS report_id, combo_sku, sub_sku, slot,
      {ratio("CASE WHEN s % 5 = 4 THEN 0 ELSE ratio END")} AS ratio
    FROM combo JOIN variants ON combo_sku = 'P' || p || '-' || s WHERE p % 90 <> 0""",
    "combo", "variants",
)
ORACLE["convert_master"] = f"""
SELECT 'M' || p_partkey % 3 AS report_id, 'P' || p_partkey AS sku, p_brand AS item_group, p_type AS product_type,
  'Kho ' || (p_size % 4) AS warehouse_type, {money('p_retailprice')} AS unit_cost
FROM part WHERE p_partkey % 50 <> 3"""
ORACLE["convert_cashflow"] = f"""
SELECT 'F' || o_orderkey % 4 AS report_id, o_orderkey::VARCHAR AS order_id, {money('floor(o_totalprice * 2)')} AS aff_fee
FROM orders WHERE o_orderkey % 3 <> 0"""
_ADJUSTMENT = f"""
SELECT 'A' || year(l_shipdate) % 4 AS report_id, {LINE_NO} AS line_no, 'T' || ({LINE_NO}) AS transaction_id,
  strftime(l_shipdate, '%d/%m/%Y') AS adjustment_date,
  CASE WHEN l_linestatus = 'F' THEN 'Hoàn tiền' ELSE 'Phạt' END AS adjustment_type,
  CASE WHEN l_linenumber % 2 = 1 THEN 'Hàng lỗi' ELSE 'Giao trễ' END AS reason,
  l_orderkey::VARCHAR AS related_order_id, strftime(l_shipdate, '%Y-%m-%d') AS payment_completed_date,
  {money('-floor(l_extendedprice * 10)')} AS amount
FROM lineitem WHERE l_returnflag = 'R'"""
ORACLE["convert_adjustments"] = f"{_ADJUSTMENT} AND l_orderkey % 59 <> 0"


def uploaded_headers(kind: str) -> str:
    """`report_id, header_pos, header` of the uploaded files; JSON columns come sorted, CSV files have a note more."""
    rows = []
    for _, fmt, reports, layout in A.upload_layouts()[kind]:
        listed = {"csv": [*list(layout)[:1], A.NOTE, *list(layout)[1:]], "json": sorted(layout), "parquet": list(layout)}[fmt]
        rows += [f"({lit(r)}, {n}, {lit(h)})" for r in reports for n, h in enumerate(listed)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") h(report_id, header_pos, header)"


def uploaded_outcomes(kind: str, keywords, penalised, first_match: bool) -> str:
    parts = scored(uploaded_headers(kind), keywords, penalised)
    if first_match:
        parts["mapped"] = _COMBOS["mapped"]
    return sql(
        f"""SELECT {lit(kind)} AS kind, h.report_id, n, headers, mapping FROM
          (SELECT report_id, string_agg(header, '|' ORDER BY header_pos) AS headers FROM headers GROUP BY report_id) h
          JOIN (SELECT report_id, string_agg(field || '=' || header, '|' ORDER BY field) AS mapping FROM mapped GROUP BY report_id) m
            ON h.report_id = m.report_id
          LEFT JOIN (SELECT report_id, count(*) AS n FROM ({ORACLE['convert_' + kind]}) GROUP BY report_id) c ON h.report_id = c.report_id""",
        extra=parts,
    )


ORACLE["uploaded_reports"] = """
SELECT kind, report_id, CASE WHEN n IS NULL THEN 'failed' ELSE 'ready' END AS status, n AS row_count,
  CASE WHEN n IS NULL THEN 'no_date_column' END AS error, headers, mapping
FROM (""" + " UNION ALL ".join(
    f"SELECT * FROM ({uploaded_outcomes(kind, words, penalised, first)})"
    for kind, words, penalised, first in (
        ("orders", S.ORDER_KEYWORDS, S.NAME_LIKE_FIELDS, False), ("combo", S.COMBO_KEYWORDS, [], True),
        ("master", S.MASTER_KEYWORDS, [], False), ("cashflow", S.CASHFLOW_KEYWORDS, [], True),
        ("adjustments", S.ADJUSTMENT_KEYWORDS, [], False),
    )
) + ")"
for _kind in ("combo", "master", "cashflow"):
    ORACLE[f"uploaded_{_kind}"] = ORACLE[f"convert_{_kind}"]
ORACLE["uploaded_orders"] = f"SELECT * EXCLUDE (line_no) FROM ({_CONVERTED})"
ORACLE["uploaded_adjustments"] = f"SELECT * EXCLUDE (line_no) FROM ({ORACLE['convert_adjustments']})"
_STORED_ORDER = [c for c in S.ORDERS_SCHEMA.names if c != "line_no"]
ORACLE["reconverted_orders"] = sql(
    f"""SELECT {shown(*_STORED_ORDER)} FROM converted WHERE report_id NOT IN ('R1996', 'R1998', 'R1999')
    UNION ALL SELECT {shown(*_STORED_ORDER)} FROM given""",
    "star",
    extra={
        **_RAW,
        "given": f"""SELECT report_id, o_orderdate AS order_ts, order_id, 'P' || l_partkey || '-' || l_suppkey AS sku_variant,
            'P' || l_partkey || '-' || l_suppkey AS product, {lit(S.UNKNOWN)} AS category, {lit(S.UNKNOWN)} AS customer,
            {STATUS} AS raw_status, CASE WHEN l_returnflag = 'A' THEN {lit(S.STATE_CANCELLED_BEFORE)}
              WHEN o_orderstatus = 'F' THEN {lit(S.STATE_COMPLETED)} ELSE {lit(S.STATE_DELIVERING)} END AS line_state,
            l_quantity AS qty, 0 AS returned_qty, l_quantity AS net_qty, 0 AS price, list_price, paid AS revenue,
            list_price * l_quantity AS gross_sales, 0 AS discount, 0 AS voucher, 0 AS platform_fee,
            CASE WHEN line_no = first_line THEN {S.SHIP_FEE_PER_ORDER}::DOUBLE ELSE 0 END AS ship_fee, 0 AS paid_ratio
          FROM priced WHERE y IN (1996, 1998) AND NOT {BAD_DATE}""",
    },
)
ORACLE["ready_reports"] = sql(
    f"""SELECT report_id, count(*) AS lines, {money(exact('gross_sales'))} AS gross_sales FROM ord
    WHERE report_id IN (SELECT report_id FROM reports WHERE status = 'ready' AND y <> 1998) GROUP BY report_id""",
    "ord", "reports",
)
stored("sink_partitioned", "order_ts", "gross_sales")
ORACLE["report_removal"] = sql(
    f"""SELECT {shown(*KEY, 'gross_sales')} FROM ord
    WHERE report_id NOT IN (SELECT report_id FROM reports WHERE status = 'processing')""",
    "ord", "reports",
)

# ---------------------------------------------------------------------------
# Row derivations
# ---------------------------------------------------------------------------
ORACLE["parent_sku"] = sql(
    """SELECT report_id, line_no, sku_variant, regexp_extract(sku_variant, '^[^-]*') AS sku
    FROM typed""",
    "typed",
)
stored("net_quantity", "qty", "returned_qty", "net_qty")
stored("gross_sales", "gross_sales")
stored("line_state", "raw_status", "line_state")
stored("revenue_fallback", "price", "revenue")
ORACLE["paid_ratio"] = sql(
    "SELECT report_id, line_no, round(paid_ratio * 1e6)::BIGINT AS paid_ppm FROM ord", "ord"
)
stored("discount_amount", "discount")
stored("voucher_amount", "voucher")
stored("platform_fee", "platform_fee")
stored("ship_fee_first_line", "ship_fee")
lines("row_gmv", "line_state", "gmv")
lines("row_scoped_discounts", "scoped_discount", "scoped_voucher")
lines("row_net_revenue", "net_revenue")
lines("row_nmv", "nmv")
lines("row_cost", "cost")
lines("row_gross_profit", "gross_profit")
lines("ship_fee_exploded", "ship_fee")
lines("combo_labels", "warehouse_type", "item_group", "product_type", "cost")
lines(
    "combo_scaling", "qty", "returned_qty", "net_qty", "price", "list_price", "revenue", "gross_sales", "discount",
    "voucher", "platform_fee", "aff_fee",
)

# ---------------------------------------------------------------------------
# Joins and set operations
# ---------------------------------------------------------------------------
lines("combo_explosion", "ratio")
ORACLE["aff_fee_join"] = sql(
    f"""SELECT o.report_id, o.line_no, o.order_id, {money('paid_ratio * coalesce(order_aff_fee, 0)')} AS line_aff_fee
    FROM ready o LEFT JOIN fees f ON o.order_id = f.order_id""",
    "ready", "fees",
)
ORACLE["aff_fee_bucketed"] = ORACLE["aff_fee_join"]
ORACLE["master_lookup"] = sql(
    f"""SELECT report_id, line_no, sku_variant, split_part(sku_variant, '-', 1) AS sku,
      coalesce(item_group, '') AS item_group, coalesce(product_type, '') AS product_type,
      coalesce(warehouse_type, '') AS warehouse_type, {money('coalesce(unit_cost, 0)')} AS unit_cost
    FROM ready LEFT JOIN master ON split_part(sku_variant, '-', 1) = sku""",
    "ready", "master",
)
ORACLE["channel_tagging"] = sql(
    f"SELECT report_id, line_no, {money('qty')} AS qty, sales_channel FROM ready JOIN reports USING (report_id)",
    "ready", "reports",
)
ORACLE["channel_lookup"] = sql("SELECT report_id, sales_channel FROM reports", "reports")
ORACLE["union_reports"] = sql(
    f"""SELECT report_id, line_no, {money('gross_sales')} AS gross_sales,
      CASE WHEN NOT {_OLD} THEN {money('voucher')} END AS voucher
    FROM (SELECT * FROM ord UNION ALL SELECT * FROM ord WHERE {_OLD})""",
    "ord",
)
_ALONE = {
    "sku": "split_part(sku_variant, '-', 1)",
    "aff_fee": "0.0::DOUBLE",
    "warehouse_type": "''",
    "item_group": "''",
    "product_type": "''",
    "cost": "0.0::DOUBLE",
    "sales_channel": "''",
    "ship_fee": f"CASE WHEN line_state <> {lit(S.STATE_CANCELLED_BEFORE)} THEN ship_fee ELSE 0 END",
    "gmv": f"CASE WHEN line_state IN {GMV} THEN list_price * net_qty ELSE 0 END",
    "net_revenue": f"CASE WHEN line_state IN {GMV} THEN list_price * net_qty - discount - voucher ELSE 0 END",
}
_ALONE["nmv"] = f"{_ALONE['net_revenue']} - platform_fee - {_ALONE['ship_fee']}"
_ALONE["gross_profit"] = _ALONE["nmv"]
ORACLE["missing_side_inputs"] = sql(
    f"SELECT {shown(*KEY, *S.DETAIL_COLUMNS)} FROM (SELECT report_id, line_no, "
    + ", ".join(f"{_ALONE.get(c, c)} AS {c}" for c in S.DETAIL_COLUMNS)
    + " FROM ready)",
    "ready",
)
lines("enriched_lines", *[c for c in S.DETAIL_COLUMNS if c not in LINE])

# ---------------------------------------------------------------------------
# Filters
# ---------------------------------------------------------------------------
_DATES = f"order_ts >= '{DATE_FROM}'::DATE AND order_ts < '{DATE_TO}'::DATE + INTERVAL 1 DAY"


def filtered(name, where, *extra):
    lines(name, "gross_sales", "gmv", *extra, where=where)


def group_sums() -> str:
    return "count(*) AS row_count, " + ", ".join(f"{money(exact(c))} AS {c}" for c in S.GROUP_SUMS)


def grouped(name, column, where="TRUE", tail=""):
    ORACLE[name] = sql(
        f"SELECT {column} AS group_value, {group_sums()} FROM enr WHERE {where} GROUP BY {column} {tail}", "enr"
    )


filtered("filter_date_range", _DATES, "order_ts")
grouped("filter_before_join", "sales_channel", _DATES)
filtered("filter_category", "category = 'ECONOMY'", "category")
filtered("filter_status_in", f"line_state IN {in_list([S.STATE_COMPLETED, S.STATE_DELIVERING])}", "line_state")
filtered("filter_warehouse_in", "warehouse_type IN ('Kho 1', 'combo')", "warehouse_type")
filtered("filter_item_group_in", "item_group IN ('Brand#2', 'Brand#4')", "item_group")
filtered("filter_product_type_in", "product_type = 'SMALL'", "product_type")
filtered("filter_channel_in", "sales_channel IN ('Sàn A', 'Cửa hàng')", "sales_channel")
filtered("filter_sku_like", "(lower(sku) LIKE '%p1_3-%' OR lower(sku_variant) LIKE '%p1_3-%')", "sku")
filtered(
    "filter_search",
    "(" + " OR ".join(
        f"lower({c}) LIKE '%red%ring%'" for c in ("product", "category", "customer", "order_id", "sku", "sku_variant")
    ) + ")",
    "product", "order_id",
)
filtered("filter_path", "category = 'ECONOMY' AND sales_channel = ''", "category", "sales_channel")

_RANGES = {
    "today": ("d", "d"),
    "yesterday": ("d - 1", "d - 1"),
    "last7": ("d - 6", "d"),
    "last30": ("d - 29", "d"),
}
for _unit in ("month", "quarter", "year"):
    _start = f"date_trunc('{_unit}', d)::DATE"
    _RANGES[f"this_{_unit}"] = (_start, "d")
    _RANGES[f"last_{_unit}"] = (f"{_start} - INTERVAL 1 {_unit}", f"{_start} - 1")
ORACLE["time_presets"] = "WITH days AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) " + " UNION ALL ".join(
    f"SELECT {date('d')} AS as_of, '{p}' AS preset, {date(_RANGES[p][0])} AS first_day, {date(_RANGES[p][1])} AS last_day "
    "FROM days"
    for p in PRESETS
)
ORACLE["time_custom_range"] = (
    "WITH parts AS (SELECT DISTINCT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, "
    "month(o_orderdate)::INT AS m FROM orders) "
    + " UNION ALL ".join(
        f"SELECT y, q, m, '{unit}' AS preset, {date(first)} AS first_day, "
        f"{date(f'{first} + INTERVAL 1 {unit} - INTERVAL 1 DAY')} AS last_day FROM parts"
        for unit, first in {
            "month": "make_date(y, m, 1)",
            "quarter": "make_date(y, q * 3 - 2, 1)",
            "year": "make_date(y, 1, 1)",
        }.items()
    )
)

# ---------------------------------------------------------------------------
# Aggregations
# ---------------------------------------------------------------------------
_STATE_SALES = "CASE WHEN line_state = {} THEN gross_sales ELSE 0 END"
_TOTALS = {
    "gross_sales": "gross_sales",
    "gmv": "gmv",
    "cancelled_before": _STATE_SALES.format(lit(S.STATE_CANCELLED_BEFORE)),
    "cancelled_after": _STATE_SALES.format(lit(S.STATE_CANCELLED_AFTER)),
    "returns": "list_price * returned_qty",
    "discount": "scoped_discount",
    "voucher": "scoped_voucher",
    "platform_fee": "platform_fee",
    "ship_fee": "ship_fee",
    "aff_fee": "aff_fee",
    "cost": f"CASE WHEN line_state IN {GMV} THEN cost ELSE 0 END",
}
_DERIVED = {"net_revenue": "net_revenue", "nmv": "nmv", "gross_profit": "gross_profit"}


def totals(columns) -> str:
    return ", ".join(f"{money(exact(e))} AS {n}" for n, e in columns.items()) + ", count(*) AS row_count"


ORACLE["kpi_totals"] = sql(f"SELECT {totals(_TOTALS)} FROM enr", "enr")
ORACLE["kpi_derived"] = sql(f"SELECT {totals(_TOTALS | _DERIVED)} FROM enr", "enr")
# The same over the uploads: every sheet counts, amounts are those of the sheets.
_UPLOADED = {
    **_RAW,
    "ready": "SELECT * FROM converted",
    "ready_combo": """SELECT combo_sku, sub_sku, slot, CASE WHEN s % 5 = 4 THEN 0 ELSE ratio END AS ratio
      FROM combo JOIN variants ON combo_sku = 'P' || p || '-' || s WHERE p % 90 <> 0""",
    "fees": "SELECT o_orderkey::VARCHAR AS order_id, floor(o_totalprice * 2) AS order_aff_fee FROM orders WHERE o_orderkey % 3 <> 0",
    "master": """SELECT 'P' || p_partkey AS sku, p_brand AS item_group, p_type AS product_type,
      'Kho ' || (p_size % 4) AS warehouse_type, p_retailprice AS unit_cost FROM part WHERE p_partkey % 50 <> 3""",
    "reports": "SELECT '' AS report_id, '' AS sales_channel",
    "enr": TABLES["enr"],
}
ORACLE["uploaded_groups"] = sql(
    f"SELECT warehouse_type AS group_value, {group_sums()} FROM enr GROUP BY warehouse_type", "star", "variants", "combo", extra=_UPLOADED
)
ORACLE["uploaded_kpis"] = sql(f"SELECT {totals(_TOTALS | _DERIVED)} FROM enr", "star", "variants", "combo", extra=_UPLOADED)


def timeline(where="TRUE") -> str:
    return (
        f"SELECT strftime(order_ts, '%Y-%m') AS month, {money(exact('gross_sales'))} AS value FROM enr "
        f"WHERE {where} GROUP BY 1"
    )


def top(column, where="TRUE") -> str:
    return (
        f"SELECT label, {money('v')} AS value FROM (SELECT {column} AS label, {exact('gross_sales')} AS v FROM enr "
        f"WHERE {where} GROUP BY 1 ORDER BY v DESC, label LIMIT 8)"
    )


def facets(where="TRUE") -> str:
    parts = []
    for name, column in S.FACETS.items():
        blank = "" if name in S.FACETS_KEEPING_BLANK else f" AND {column} <> ''"
        parts.append(f"SELECT DISTINCT '{name}' AS facet, {column} AS value FROM enr WHERE {where}{blank}")
    return " UNION ALL ".join(parts)


ORACLE["monthly_timeline"] = sql(timeline(), "enr")
ORACLE["top_products"] = sql(top("product"), "enr")
ORACLE["category_breakdown"] = sql(top("category"), "enr")
ORACLE["top_customers"] = sql(top("customer"), "enr")
ORACLE["facets"] = sql(facets(f"order_ts >= '{DATE_FROM}'::DATE"), "enr")


def summary(where, dates_only) -> str:
    numbers = {**_TOTALS, **_DERIVED}
    parts = [
        f"SELECT 'kpis' AS section, '{n}' AS label, {money(exact(e))} AS value FROM enr WHERE {where}"
        for n, e in numbers.items()
    ]
    parts.append(f"SELECT 'kpis', 'row_count', {money('count(*)::DOUBLE')} FROM enr WHERE {where}")
    parts.append(f"SELECT 'timeline', month, value FROM ({timeline(where)})")
    for name, column in (("top_products", "product"), ("category_breakdown", "category"), ("top_customers", "customer")):
        parts.append(f"SELECT '{name}', label, value FROM ({top(column, where)})")
    parts.append(f"SELECT facet, value, NULL FROM ({facets(dates_only)})")
    return sql(" UNION ALL ".join(parts), "enr")


ORACLE["summary_bundle"] = summary(f"{_DATES} AND category = 'ECONOMY'", _DATES)
ORACLE["single_report_summary"] = summary("report_id = 'R1996'", "report_id = 'R1996'").replace(
    "coalesce(r.sales_channel, '') AS sales_channel", "'' AS sales_channel"
)
ORACLE["facet_order"] = sql(
    f"""SELECT facet, value, CASE WHEN facet = 'statuses'
      THEN list_position([{', '.join(lit(s) for s in S.STATE_ORDER)}], value) ELSE 0 END::INT AS state_rank
    FROM ({facets()})""",
    "enr",
)

# ---------------------------------------------------------------------------
# Groups
# ---------------------------------------------------------------------------
for _key, _column in S.GROUP_KEYS.items():
    grouped(f"grouped_by_{_key}", _column)
ORACLE["grouped_total"] = sql(
    " UNION ALL ".join(
        f"SELECT '{k}' AS group_key, count(DISTINCT {k}) AS total FROM enr" for k in ("sku", "order_id", "product")
    ),
    "enr",
)
grouped("grouped_page", "sku", tail=f"ORDER BY {exact('nmv')} NULLS LAST, sku LIMIT 15 OFFSET 30")
grouped("grouped_nested", "line_state", "category = 'SMALL' AND sales_channel = 'Sàn B'")
ORACLE["grouped_tree_rollup"] = sql(
    f"""SELECT 1 AS depth, category, NULL AS line_state, NULL AS product, {group_sums()} FROM enr GROUP BY category
    UNION ALL SELECT 2, category, line_state, NULL, {group_sums()} FROM enr GROUP BY category, line_state
    UNION ALL SELECT 3, category, line_state, product, {group_sums()} FROM enr GROUP BY category, line_state, product""",
    "enr",
)

# ---------------------------------------------------------------------------
# Sort, paging, export
# ---------------------------------------------------------------------------
_DETAIL = shown(*S.DETAIL_COLUMNS)
ORACLE["detail_sorted"] = sql(f"SELECT {_DETAIL} FROM enr", "enr")
for _name, _offset in (("detail_page", 45), ("detail_next_page", 60), ("detail_deep_page", 15000)):
    ORACLE[_name] = sql(
        f"""SELECT {_DETAIL} FROM (SELECT * FROM enr ORDER BY gross_sales DESC NULLS LAST, report_id, line_no,
          slot NULLS LAST, sku_variant LIMIT 15 OFFSET {_offset})""",
        "enr",
    )
ORACLE["detail_total"] = sql(
    "SELECT count(*) AS total, greatest(ceil(count(*) / 15.0), 1)::BIGINT AS pages FROM enr WHERE "
    + " OR ".join(
        f"lower({c}) LIKE '%red%'" for c in ("product", "category", "customer", "order_id", "sku", "sku_variant")
    ),
    "enr",
)
ORACLE["detail_drilldown"] = sql(
    f"""SELECT {_DETAIL} FROM enr WHERE category = 'SMALL' AND line_state = {lit(S.STATE_COMPLETED)}
      AND sales_channel = 'Sàn B'""",
    "enr",
)
ORACLE["adjustments_page"] = f"""
SELECT * EXCLUDE (report_id) FROM ({_ADJUSTMENT}) WHERE report_id = 'A1' ORDER BY line_no LIMIT 15 OFFSET 15"""
ORACLE["report_listing"] = sql(
    "SELECT report_id, 'don hang ' || y AS name, y || '-12-31 00:00:00' AS uploaded_at, status FROM reports", "reports"
)
ORACLE["export_detail"] = sql(f"SELECT {_DETAIL} FROM enr", "enr")
grouped("export_grouped", "customer")
ORACLE["export_projection"] = sql(
    f"""SELECT order_id AS "{S.DETAIL_LABELS['order_id']}", {money('gross_sales')} AS "{S.DETAIL_LABELS['gross_sales']}",
      line_state AS "{S.DETAIL_LABELS['line_state']}", sku_variant AS "{S.DETAIL_LABELS['sku_variant']}" FROM enr""",
    "enr",
)
