"""A run of a chained query reads the facts once."""

import pytest

import __spark_entry__ as entry
from kerbflow.sources import adapter

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["zone_universe", "validation_points", "calibrated_rebuild", "top_zone_difference", "hourly_displacement"])
def test_one_build_of_the_facts(spark, monkeypatch, name):
    built = []
    original = adapter.violations
    monkeypatch.setattr(adapter, "violations", lambda *a: built.append(1) or original(*a))
    entry.queries()[name](spark, FOLDER)
    assert len(built) == 1
