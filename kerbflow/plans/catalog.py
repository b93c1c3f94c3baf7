"""Registry: query name to Spark function and, where SQL can express it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.functions.basics import half_up
from kerbflow.plans import tables
from kerbflow.plans.oracle import compose, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# Slightly above one half: an exact tie rounds up even when two engines differ in the last bits of a sum.
NUDGED = 0.5001


def _rounded(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Round half up with the same arithmetic as the twin, so equal doubles stay equal."""
    return df.withColumns({name: half_up(F.col(name).cast("double"), digits, NUDGED) for name, digits in columns.items()})


def query(name: str, sql: str | None = None, floats: Iterable[str] | dict[str, int] = ()) -> Callable[[Query], Query]:
    """Register a query. ``floats`` are rounded the same way on both sides before comparing."""
    columns = floats if isinstance(floats, dict) else dict.fromkeys(floats, 6)

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            tables.new_run()
            df = function(spark, folder)
            return _rounded(df, columns) if columns else df

        QUERIES[name] = run
        if sql is not None:
            final = sql
            if columns:
                parts = ", ".join(f"{rounded(name, digits, NUDGED)} AS {name}" for name, digits in columns.items())
                final = f"SELECT * REPLACE ({parts}) FROM ({sql}) q"
            ORACLES[name] = compose(final)
        return function

    return add
