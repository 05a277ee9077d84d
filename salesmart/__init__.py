"""Retail-sales data quality, enrichment and metrics as Spark DataFrame operators."""

from salesmart.config import SalesConfig
from salesmart.operators.filters import SalesFilter
from salesmart.plans.etl import EtlReport, run_etl
from salesmart.plans.mart import SalesMart

__all__ = ["EtlReport", "SalesConfig", "SalesFilter", "SalesMart", "run_etl"]
