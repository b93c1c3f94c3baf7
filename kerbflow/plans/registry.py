"""Imports every query module so that the catalog is complete."""

from kerbflow.plans import cluster_queries, panel_queries, profile_queries, risk_queries, serving_queries, source_queries, stats_queries, zone_queries  # noqa: F401
from kerbflow.plans.catalog import ORACLES, QUERIES  # noqa: F401
