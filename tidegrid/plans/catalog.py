"""All registered queries; importing the areas fills the catalog."""

from tidegrid.plans import queries_anomaly, queries_composite, queries_grid, queries_layout, queries_long, queries_modes, queries_plans, queries_select, queries_series, queries_spectral  # noqa: F401
from tidegrid.plans.registry import CATALOG, Query

__all__ = ["CATALOG", "Query"]
