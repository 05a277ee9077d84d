"""Filtered questions over the loaded table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from salesmart.config import SalesConfig
from salesmart.operators import dimensions, metrics
from salesmart.operators.facts import CUBE_KEYS, cube, facts, with_discount_band
from salesmart.operators.filters import SalesFilter
from salesmart.sinks.table import CUBE, kept_beside
from salesmart.sources.table import Loader, table_loader, with_fallback


@dataclass(frozen=True)
class Dashboard:
    """One lazy result per panel.

    The panels grouped by small keys share cached aggregates; ``close`` frees them.
    """

    shared: tuple[DataFrame, ...]
    panels: dict[str, DataFrame]

    def __getitem__(self, panel: str) -> DataFrame:
        return self.panels[panel]

    def close(self) -> None:
        for frame in self.shared:
            frame.unpersist()


class SalesMart:
    """The enriched ``sales`` table as a set of questions.

    Filters fold into the scan: a year becomes partition pruning, the others
    are pushed to the files.
    """

    def __init__(
        self,
        spark: SparkSession,
        source: str | Loader = "sales",
        fallback_csv: str | None = None,
        config: SalesConfig = SalesConfig(),
        *,
        multi_line: bool = False,
    ):
        """``source`` is a catalog table's name or any loader, as of a database
        table; ``fallback_csv`` is read where the source cannot be."""
        self.spark = spark
        self.config = config
        self.table = source if isinstance(source, str) else None
        self.load = table_loader(source) if isinstance(source, str) else source
        if fallback_csv is not None:
            self.load = with_fallback(self.load, fallback_csv, config, multi_line=multi_line)
        self.refresh()

    def refresh(self) -> None:
        """See the rows of the latest load, and the cube kept beside them."""
        while True:
            kept = self._kept()
            self.rows = self.load(self.spark)
            self.kept = self._kept()
            # Another load may have been published in between.
            if (kept is None) == (self.kept is None) and (kept is None or kept.sameSemantics(self.kept)):
                return

    def _kept(self) -> DataFrame | None:
        return None if self.table is None else kept_beside(self.spark, self.table, CUBE)

    def filtered(self, chosen: SalesFilter = SalesFilter()) -> DataFrame:
        return chosen.apply(self.rows)

    def options(self) -> DataFrame:
        return dimensions.filter_options(self.rows)

    def date_bounds(self) -> DataFrame:
        return dimensions.date_bounds(self.rows)

    def dashboard(self, chosen: SalesFilter = SalesFilter(), approximate: bool = False) -> Dashboard:
        """All panels under one filter, from four scans instead of one per panel:
        the cube, the segments with the headline figures, products, recent rows.

        Where the filter asks for keys of the kept cube only, that is read in
        place of the first scan. With ``approximate``, customers are counted by
        sketches, off by ``SKETCH_ERROR``, and the second scan is spared as well.
        """
        rows = self.filtered(chosen)
        fact_rows = facts(rows, self.config)
        keys = CUBE_KEYS
        if "discount_pct" not in rows.columns:
            keys = tuple(key for key in CUBE_KEYS if key != "discount_band")
        small = None
        if self.kept is not None and set(chosen.columns()) <= set(self.kept.columns):
            small = chosen.apply(self.kept)
        # Bounded by months x categories x regions x tiers x bands.
        if small is not None:
            shared = cube(small, keys).persist()
        else:
            shared = cube(with_discount_band(fact_rows) if "discount_band" in keys else fact_rows, keys).persist()
        months = metrics.month_facts(shared)
        by_segment = small if approximate and small is not None else fact_rows
        segments = metrics.segment_facts(by_segment, approximate).persist()
        summary = metrics.kpi_of_segments(segments)
        growth = metrics.mom_growth(months)
        top = metrics.top_products(fact_rows)
        tiers = metrics.profit_tier_orders(shared)
        panels = {
            "kpis": metrics.kpi_cards(summary),
            "monthly": metrics.monthly_trend(months),
            "category": metrics.category_share(shared),
            "rolling": metrics.rolling_3m(months),
            "growth": metrics.mom_growth_label(growth),
            "region": metrics.region_perf(shared),
            "products": metrics.top_products_label(top),
            "tier": metrics.profit_tier_label(tiers),
            "segment": metrics.segment_panel(segments),
            "recent": metrics.recent_formatted(metrics.recent_orders(rows)),
        }
        if "discount_band" in keys:
            panels["discount"] = metrics.discount_label(metrics.discount_impact(shared))
        return Dashboard((shared, segments), panels)
