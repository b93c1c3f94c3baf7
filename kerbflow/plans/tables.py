"""Derived tables shared by the queries.

Within one run of a query the facts are read and condensed once (``fact_base``); nothing is kept for the next run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.operators import scoring, zones
from kerbflow.session import materialise
from kerbflow.sources import adapter

_RUN: dict[tuple[str, str, str], DataFrame] = {}


def new_run() -> None:
    """Forget the shared table of the query that ran before."""
    _RUN.clear()


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return adapter.violations(spark, folder)


def once(spark: SparkSession, folder: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stored table that a run builds when it is first asked for."""
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _RUN:
        _RUN[key] = materialise(build(), label)
    return _RUN[key]


def fact_base(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "fact-base", lambda: zones.fact_base(facts(spark, folder)))


def zone_places(spark: SparkSession, folder: str) -> DataFrame:
    """Zones with any record and their indices."""
    return fact_base(spark, folder).select("zone_id", "zi", "zj").distinct()


def ratios(spark: SparkSession, folder: str) -> DataFrame:
    per_zone = fact_base(spark, folder).groupBy("zone_id").agg(F.sum("signal").alias("total"), F.sum("signals").alias("n"))
    return adapter.measured_ratios(per_zone)


def zone_table(spark: SparkSession, folder: str) -> DataFrame:
    """Zone aggregate with ratios; lazy above the condensed facts."""
    return zones.aggregate_base(fact_base(spark, folder), ratios(spark, folder))


def stored_zone_table(spark: SparkSession, folder: str) -> DataFrame:
    """Stored once a run, however many branches score it."""
    return once(spark, folder, "zone-table", lambda: zone_table(spark, folder))


def impact_table(spark: SparkSession, folder: str) -> DataFrame:
    """Scored zone table over a stored aggregate."""
    return scoring.score(stored_zone_table(spark, folder))
