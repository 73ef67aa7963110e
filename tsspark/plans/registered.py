"""All registered queries, gathered from the catalogues."""

from tsspark.plans import (  # noqa: F401  (importing registers)
    catalog_etl,
    catalog_drift,
    catalog_evaluation,
    catalog_insights,
    catalog_models,
    catalog_monitoring,
    catalog_series,
    catalog_streaming,
)
from tsspark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
