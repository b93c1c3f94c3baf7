"""A spread of registered queries next to their DuckDB twins on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["zone_bucket_aggregate", "impact_breakdown", "composite_risk", "hourly_allocation", "hourly_displacement", "zone_universe",
          "coverage_curve", "day_panel", "spatial_lag", "validation_points", "cluster_labels", "workflow_latency", "artifact_round_trip", "frozen_snapshot"]


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(SAMPLE) <= set(oracles)
    assert len(queries) > 150


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, name):
    assert differences(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) is None
