"""Dashboard filters as one value object that yields Column predicates."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens import schemas as S
from marketlens.functions.text import contains_pattern

_SEARCHED = ["product", "category", "customer", "order_id", "sku", "sku_variant"]


def chosen(values: str | list[str] | None) -> list[str]:
    """Values of a multi-select: one text or a list, blanks dropped."""
    if isinstance(values, str):
        values = [values]
    return [v for v in values or [] if v]


@dataclass(frozen=True)
class Filters:
    """Everything a user can narrow the dashboard by; empty means no restriction."""

    date_from: dt.date | Column | None = None
    date_to: dt.date | Column | None = None
    category: str | None = None
    status: str | list[str] | None = None
    warehouse_type: str | list[str] | None = None
    item_group: str | list[str] | None = None
    product_type: str | list[str] | None = None
    sales_channel: str | list[str] | None = None
    sku: str | None = None
    search: str | None = None
    path: list[tuple[str, str | None]] = field(default_factory=list)

    def _multi(self) -> dict[str, list[str]]:
        given = {
            "line_state": self.status,
            "warehouse_type": self.warehouse_type,
            "item_group": self.item_group,
            "product_type": self.product_type,
            "sales_channel": self.sales_channel,
        }
        return {column: chosen(values) for column, values in given.items() if chosen(values)}

    def _path(self) -> list[tuple[str, str]]:
        return [(S.GROUP_KEYS[k], v) for k, v in self.path if k in S.GROUP_KEYS and v is not None]

    def columns(self) -> list[str]:
        """Enriched columns the predicates look at (dates are applied before enrichment)."""
        used = ["category"] if self.category else []
        used += list(self._multi())
        used += ["sku", "sku_variant"] if self.sku else []
        used += _SEARCHED if self.search else []
        used += [column for column, _ in self._path()]
        return list(dict.fromkeys(used))

    def condition(self) -> Column | None:
        """All predicates but the date range, or None."""
        parts = [F.col(c).isin(v) for c, v in self._multi().items()]
        if self.category:
            parts.append(F.col("category") == self.category)
        if self.sku:
            parts.append(any_contains(["sku", "sku_variant"], self.sku))
        if self.search:
            parts.append(any_contains(_SEARCHED, self.search))
        parts += [F.col(c) == v for c, v in self._path()]
        if not parts:
            return None
        condition = parts[0]
        for part in parts[1:]:
            condition = condition & part
        return condition

    def dates_only(self) -> Filters:
        return Filters(date_from=self.date_from, date_to=self.date_to)

    def under(self, *path: tuple[str, str | None]) -> Filters:
        return replace(self, path=[*self.path, *path])


def any_contains(columns: list[str], text: str) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | contains_pattern(F.col(c), text)
    return found


def check_path(path: list[tuple[str, str | None]]) -> None:
    """Strict check of a drill-down path, for callers that reject unknown keys instead of ignoring them."""
    for key, _ in path:
        if key not in S.GROUP_KEYS:
            raise ValueError(f"unknown group key: {key}")
