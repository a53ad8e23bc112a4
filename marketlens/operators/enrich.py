"""Enriched lines: order lines x channel x affiliate fee x combo parts x product master."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schemas as S
from marketlens.functions import money
from marketlens.functions.text import parent_sku
from marketlens.operators.skew import hot_keys, key_sketches, lookup_join, sketched_keys
from marketlens.sources.reports import keep_ready, ready_ids

# Reports whose ids a plan names one by one.
MOST_NAMED = 5_000
Hot = Callable[[], DataFrame] | None

_AFF = {"order_id", "paid_ratio"}
_GMV = {"line_state", "list_price", "net_qty"}
_NET = _GMV | {"discount", "voucher"}
_SHIP = {"ship_fee", "line_state"}
_NMV = _NET | _SHIP | _AFF | {"platform_fee"}
# Order columns an enriched column is computed from, where not just itself.
_READS = {
    "sku": {"sku_variant"},
    "slot": set(),
    "ship_fee": _SHIP,
    "aff_fee": _AFF,
    "warehouse_type": {"sku_variant"},
    "item_group": {"sku_variant"},
    "product_type": {"sku_variant"},
    "cost": {"net_qty", "sku_variant"},
    "gmv": _GMV,
    "net_revenue": _NET,
    "nmv": _NMV,
    "gross_profit": _NMV | {"sku_variant"},
    "sales_channel": {"report_id"},
}
_FROM_FEES = {"aff_fee", "nmv", "gross_profit"}
_FROM_MASTER = {"warehouse_type", "item_group", "product_type", "cost", "gross_profit"}
_MASTER_VALUES = ["item_group", "product_type", "warehouse_type", "unit_cost"]


@dataclass
class Sources:
    """The five inputs; any of the last four may be absent.

    `channels` holds `report_id, sales_channel`, `keys` what `order_keys` keeps
    of the order lines: with it no join counts the keys of all lines.
    """

    orders: DataFrame | None
    combo: DataFrame | None = None
    cashflow: DataFrame | None = None
    master: DataFrame | None = None
    channels: DataFrame | None = None
    keys: DataFrame | None = None

    def order_lines(self, columns: list[str]) -> DataFrame:
        """Stored order lines; a column no report has is simply not there."""
        orders = self.orders
        if orders is None:
            orders = SparkSession.active().createDataFrame([], S.ORDERS_SCHEMA)
        return orders.select(*[c for c in columns if c in orders.columns])

    def ready(self, manifest: DataFrame) -> Sources:
        """What the ready reports of each kind hold; the others are not visible yet.

        The manifest is asked once, and its report ids become filters on the
        tables' partitions; beyond MOST_NAMED reports they are joined instead.
        """
        named = ready_ids(manifest, MOST_NAMED)

        def kept(table, kind):
            if table is None:
                return None
            if named is None:
                return keep_ready(table, manifest, kind)
            return table.filter(F.col("report_id").isin(named.get(kind, [])))

        return Sources(
            kept(self.orders, "orders"), kept(self.combo, "combo"), kept(self.cashflow, "cashflow"),
            kept(self.master, "master"), self.channels, self.keys,
        )

    def for_report(self, report_id: str) -> Sources:
        """One report's lines with all side inputs, and no channel tags."""
        one = self.orders.filter(F.col("report_id") == report_id)
        return Sources(one, self.combo, self.cashflow, self.master, keys=self.keys)

    def hot(self, lines: DataFrame, column: str) -> Callable[[], DataFrame]:
        """A way to the frequent values of a column of the stored `lines`, for joins on it."""
        if self.keys is None:
            return lambda: hot_keys(lines, [column])
        return lambda: sketched_keys(self.keys, column)

    def hot_skus(self, lines: DataFrame) -> Callable[[], DataFrame]:
        """The same for parent SKUs after combos are replaced by their parts."""
        def frequent():
            if self.keys is None:
                parts = explode_combo(lines, self.combo)
                return hot_keys(parts.select(parent_sku(F.col("sku_variant")).alias("sku")), ["sku"])
            own = sketched_keys(self.keys, "sku")
            if self.combo is None:
                return own
            sold = sketched_keys(self.keys, "sku_variant")
            parts = self.combo.join(F.broadcast(sold), F.col("combo_sku") == F.col("sku_variant"), "left_semi")
            return own.unionByName(parts.select(parent_sku(F.col("sub_sku")).alias("sku"))).distinct()

        return frequent


def order_columns(columns: list[str], sources: Sources) -> list[str]:
    """Order columns needed to compute the enriched `columns`."""
    needed = set()
    for c in columns:
        needed |= _READS.get(c, {c})
    if sources.combo is not None:
        needed.add("sku_variant")
    return [c for c in S.ORDERS_SCHEMA.names if c in needed]


def or_zero(df: DataFrame, name: str) -> Column:
    """A column that reports may lack, wholly or in part: 0 where it is missing."""
    return F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def date_range(df: DataFrame, date_from: dt.date | Column | None, date_to: dt.date | Column | None) -> DataFrame:
    """Lines from the first to the last day, both whole."""
    if date_from is not None:
        df = df.filter(F.col("order_ts") >= F.lit(date_from).cast("date").cast("timestamp_ntz"))
    if date_to is not None:
        df = df.filter(F.col("order_ts") < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp_ntz"))
    return df


def tag_channels(lines: DataFrame, channels: DataFrame | None) -> DataFrame:
    """Channel of each line's report, '' where it has none."""
    if channels is None:
        return lines.withColumn("sales_channel", F.lit(""))
    tags = channels.select("report_id", "sales_channel")
    return lookup_join(lines, tags, ["report_id"]).withColumn(
        "sales_channel", F.coalesce("sales_channel", F.lit(""))
    )


def order_keys(orders: DataFrame) -> DataFrame:
    """Sketches of the keys order lines are joined on, one row per report; kept when a report is stored."""
    variant = F.col("sku_variant")
    return key_sketches(orders, {"order_id": F.col("order_id"), "sku_variant": variant, "sku": parent_sku(variant)}, ["report_id"])


def fee_per_order(cashflow: DataFrame) -> DataFrame:
    """Affiliate fee of an order over all cashflow reports."""
    return cashflow.groupBy("order_id").agg(F.sum("aff_fee").alias("order_aff_fee"))


def join_aff_fee(lines: DataFrame, cashflow: DataFrame | None, hot: Hot = None) -> DataFrame:
    """The line's share of its order's affiliate fee, before combo scaling.

    Here and below `hot` may name a way to the frequent keys that reads less
    than the lines do after the joins before.
    """
    if cashflow is None:
        return lines.withColumn("line_aff_fee", F.lit(0.0))
    share = or_zero(lines, "paid_ratio")
    joined = lookup_join(lines, fee_per_order(cashflow), ["order_id"], hot=hot)
    return joined.withColumn("line_aff_fee", share * F.coalesce("order_aff_fee", F.lit(0.0))).drop("order_aff_fee")


def explode_combo(lines: DataFrame, combo: DataFrame | None, hot: Hot = None) -> DataFrame:
    """Replace a combo line by its parts; other lines stay as they are with ratio 1 and no slot."""
    if combo is None:
        return lines.withColumn("ratio", F.lit(1.0)).withColumn("slot", F.lit(None).cast("int"))
    parts = combo.select(F.col("combo_sku").alias("sku_variant"), "sub_sku", "ratio", "slot")
    return (
        lookup_join(lines, parts, ["sku_variant"], hot=hot)
        .withColumn("sku_variant", F.coalesce("sub_sku", "sku_variant"))
        .withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
        .drop("sub_sku")
    )


def one_per_sku(master: DataFrame, values: list[str] | None = None) -> DataFrame:
    """One master row per SKU. Where rows disagree the smallest value of each field is taken."""
    return master.groupBy("sku").agg(*[F.min(v).alias(v) for v in values or _MASTER_VALUES])


def join_master(
    lines: DataFrame, master: DataFrame | None, values: list[str] | None = None, hot: Hot = None
) -> DataFrame:
    """Labels and unit cost by parent SKU of the exploded variant; '' and 0 where there is none."""
    values = values or _MASTER_VALUES
    blank = {v: F.lit(0.0) if v == "unit_cost" else F.lit("") for v in values}
    lines = lines.withColumn("sku", parent_sku(F.col("sku_variant")))
    if master is None:
        return lines.withColumns(blank)
    joined = lookup_join(lines, one_per_sku(master, values), ["sku"], hot=hot)
    return joined.withColumns({v: F.coalesce(F.col(v), blank[v]) for v in values})


def enriched_values(lines: DataFrame) -> dict[str, Column]:
    """Output expressions over exploded and joined lines."""
    c = F.col
    ratio, state, net = c("ratio"), c("line_state"), c("net_qty")
    scaled_discount = or_zero(lines, "discount") * ratio
    scaled_voucher = or_zero(lines, "voucher") * ratio
    scaled_platform = or_zero(lines, "platform_fee") * ratio
    ship = money.kept_ship_fee(or_zero(lines, "ship_fee"), c("slot"), state)
    aff = c("line_aff_fee") * ratio
    gmv = money.scoped(state, c("list_price") * ratio * net)
    net_revenue = gmv - money.scoped(state, scaled_discount) - money.scoped(state, scaled_voucher)
    nmv = net_revenue - scaled_platform - ship - aff
    cost = net * c("unit_cost")
    labels = {
        name: F.when(c("slot").isNotNull(), S.COMBO_LABEL).otherwise(c(name))
        for name in ("warehouse_type", "item_group", "product_type")
    }
    return {
        "sku": parent_sku(c("sku_variant")),
        **{name: c(name) * ratio for name in ("price", "list_price", "revenue", "gross_sales")},
        "discount": scaled_discount,
        "voucher": scaled_voucher,
        "platform_fee": scaled_platform,
        "ship_fee": ship,
        "aff_fee": aff,
        **labels,
        "cost": cost,
        "gmv": gmv,
        "net_revenue": net_revenue,
        "nmv": nmv,
        "gross_profit": nmv - money.scoped(state, cost),
    }


def enrich(
    sources: Sources,
    columns: list[str] | None = None,
    date_from: dt.date | Column | None = None,
    date_to: dt.date | Column | None = None,
) -> DataFrame:
    """Enriched lines with the asked columns, in that order.

    Dates are filtered on the stored lines, so the range reaches the scan.
    The fee and master joins keep the row count, so each is left out when no
    asked column depends on it. Fees come before the explosion: fewer rows go
    through the one join whose side grows with the data.
    """
    columns = columns or S.DETAIL_COLUMNS
    wanted = set(columns)
    dated = date_from is not None or date_to is not None
    base = order_columns([*columns, "order_ts"] if dated else columns, sources)
    stored = date_range(sources.order_lines(base), date_from, date_to)
    lines = stored
    if "sales_channel" in wanted:
        lines = tag_channels(lines, sources.channels)
    if wanted & _FROM_FEES:
        lines = join_aff_fee(lines, sources.cashflow, sources.hot(stored, "order_id"))
    lines = explode_combo(lines, sources.combo, sources.hot(stored, "sku_variant"))
    if wanted & _FROM_MASTER:
        values = [v for v in _MASTER_VALUES if v in wanted or v == "unit_cost" and wanted & {"cost", "gross_profit"}]
        lines = join_master(lines, sources.master, values, sources.hot_skus(stored))
    values = enriched_values(lines)
    return lines.select(*[values.get(c, F.col(c)).alias(c) for c in columns])
