"""The dashboard's questions over one set of sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schemas as S
from marketlens.operators import grouping, metrics, paging
from marketlens.operators.enrich import Sources, enrich
from marketlens.operators.filters import Filters
from marketlens.sources.store import ReportStore

_NO_FILTERS = Filters()


class Dashboard:
    """Every method but `write_pages` returns a lazy DataFrame that reads only the columns and joins it needs."""

    def __init__(self, sources: Sources, manifest: DataFrame | None = None):
        """With a manifest only ready reports count, of every kind."""
        self.sources = sources if manifest is None else sources.ready(manifest)

    @classmethod
    def of_store(cls, store: ReportStore, channels: DataFrame | None = None) -> Dashboard:
        """Over the ready reports of a store, all of one snapshot."""
        at = store.snapshot()
        tables = [store.table(kind, at) for kind in ("orders", "combo", "cashflow", "master")]
        return cls(Sources(*tables, channels, store.order_keys(at)))

    def lines(self, filters: Filters = _NO_FILTERS, columns: list[str] | None = None) -> DataFrame:
        """Enriched lines under the filters."""
        columns = columns or S.DETAIL_COLUMNS
        both = list(dict.fromkeys([*columns, *filters.columns()]))
        lines = enrich(self.sources, both, filters.date_from, filters.date_to)
        condition = filters.condition()
        if condition is not None:
            lines = lines.filter(condition)
        return lines.select(*columns)

    # -- summary ----------------------------------------------------------

    def kpis(self, filters: Filters = _NO_FILTERS) -> DataFrame:
        return metrics.kpi_derived(metrics.kpi_totals(self.lines(filters, metrics.KPI_COLUMNS)))

    def timeline(self, filters: Filters = _NO_FILTERS) -> DataFrame:
        return metrics.monthly_timeline(self.lines(filters, ["order_ts", "gross_sales"]))

    def top(self, column: str, filters: Filters = _NO_FILTERS, n: int = metrics.TOP_N) -> DataFrame:
        return metrics.top_by_sales(self.lines(filters, [column, "gross_sales"]), column, n)

    def facets(self, filters: Filters = _NO_FILTERS) -> DataFrame:
        """Choices for the date range alone; other filters do not narrow them."""
        return metrics.facets(self.lines(filters.dates_only(), list(S.FACETS.values())))

    def summary(self, filters: Filters = _NO_FILTERS) -> dict[str, DataFrame]:
        """The parts of the summary, each a plan of its own.

        Only the KPIs need the fee join; keeping the parts apart reads a few
        narrow columns more often instead of storing all enriched lines.
        """
        return {
            "kpis": self.kpis(filters),
            "timeline": self.timeline(filters),
            "top_products": self.top("product", filters),
            "category_breakdown": self.top("category", filters),
            "top_customers": self.top("customer", filters),
            "facets": self.facets(filters),
        }

    def summary_rows(self, filters: Filters = _NO_FILTERS) -> DataFrame:
        """The whole summary as one table `section, label, value`; facet rows have no value.

        One pass with all sums, by month and category, gives the KPIs, the timeline and the categories; the
        lists of products and customers take a narrow pass each, and the facets, which follow the dates only, another.
        """
        sums = metrics.summary_sections(
            self.lines(filters, metrics.SUMMARY_COLUMNS),
            {c: self.lines(filters, [c, "gross_sales"]) for c in ("product", "customer")},
        )
        no_value = F.lit(None).cast("double").alias("value")
        choices = self.facets(filters).select(F.col("facet").alias("section"), F.col("value").alias("label"), no_value)
        return sums.unionByName(choices)

    # -- groups -----------------------------------------------------------

    def _group_lines(self, filters: Filters, keys: list[str], sums: bool = True) -> DataFrame:
        columns = [S.GROUP_KEYS[k] for k in keys]
        return self.lines(filters, [*columns, *(S.GROUP_SUMS if sums else [])])

    def grouped(self, key: str, filters: Filters = _NO_FILTERS) -> DataFrame:
        if key not in S.GROUP_KEYS:
            return grouping.empty_groups(SparkSession.active())
        return grouping.grouped(self._group_lines(filters, [key]), key)

    def grouped_page(
        self, key: str, filters: Filters = _NO_FILTERS, sort: str = "gross_sales", direction: str = "desc",
        number: int = 1, size: int = paging.PAGE_SIZE,
    ) -> DataFrame:
        return paging.page(self.grouped(key, filters), paging.group_order(sort, direction), number, size)

    def group_total(self, key: str, filters: Filters = _NO_FILTERS) -> DataFrame:
        return grouping.group_total(self._group_lines(filters, [key], sums=False), key)

    def group_totals(self, keys: list[str], filters: Filters = _NO_FILTERS) -> DataFrame:
        return grouping.group_totals(self._group_lines(filters, keys, sums=False), keys)

    def group_tree(self, keys: list[str], filters: Filters = _NO_FILTERS) -> DataFrame:
        return grouping.group_tree(self._group_lines(filters, keys), keys)

    # -- detail -----------------------------------------------------------

    def _keyed(self, filters: Filters) -> DataFrame:
        return self.lines(filters, list(dict.fromkeys([*S.DETAIL_COLUMNS, *S.LINE_KEY])))

    def rows(self, filters: Filters = _NO_FILTERS, sort: str = "order_ts", direction: str = "asc") -> DataFrame:
        """All matching lines in order."""
        return self._keyed(filters).orderBy(*paging.detail_order(sort, direction)).select(*S.DETAIL_COLUMNS)

    def rows_page(
        self, filters: Filters = _NO_FILTERS, sort: str = "order_ts", direction: str = "asc",
        number: int = 1, size: int = paging.PAGE_SIZE, keys: bool = False,
    ) -> DataFrame:
        """One page by its number; with `keys` also the line key, which `rows_after` takes."""
        found = paging.page(self._keyed(filters), paging.detail_order(sort, direction), number, size)
        return found if keys else found.select(*S.DETAIL_COLUMNS)

    def rows_after(
        self, last: Mapping, filters: Filters = _NO_FILTERS, sort: str = "order_ts", direction: str = "asc",
        size: int = paging.PAGE_SIZE, keys: bool = False,
    ) -> DataFrame:
        """The page after a row of an earlier one, at the same cost however far back."""
        column = sort if sort in S.DETAIL_SORT_COLUMNS else "order_ts"
        found = paging.rows_after(self._keyed(filters), column, direction, S.LINE_KEY, last, size)
        return found if keys else found.select(*S.DETAIL_COLUMNS)

    def write_pages(
        self, path: str, filters: Filters = _NO_FILTERS, sort: str = "order_ts", direction: str = "asc"
    ) -> None:
        """Write all matching lines numbered, for pages by `stored_page`."""
        paging.write_numbered(self._keyed(filters), paging.detail_order(sort, direction), path)

    def stored_page(self, path: str, number: int = 1, size: int = paging.PAGE_SIZE) -> DataFrame:
        found = paging.stored_page(self.sources.orders.sparkSession, path, number, size)
        return found.select(*S.DETAIL_COLUMNS)

    def rows_total(self, filters: Filters = _NO_FILTERS) -> DataFrame:
        return self.lines(filters, ["line_state"]).agg(F.count(F.lit(1)).alias("total"))

    # -- export -----------------------------------------------------------

    def export(
        self, columns: list[str], filters: Filters = _NO_FILTERS, group_key: str | None = None,
        sort: str | None = None, direction: str = "asc",
    ) -> DataFrame:
        """All matching lines, or all top-level groups, sorted and relabelled."""
        if group_key is None:
            return paging.relabel(self.rows(filters, sort or "order_ts", direction), columns)
        if group_key not in S.GROUP_KEYS:
            raise ValueError(f"unknown group key: {group_key}")
        groups = self.grouped(group_key, filters).orderBy(*paging.group_order(sort, direction))
        return paging.relabel(groups, columns, group_key)
