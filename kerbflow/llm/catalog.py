"""Registry of the subpackage's queries and their DuckDB twins."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="sources-")  # on the driver, which serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, f"{package.name}_sources.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its twin."""

    def add(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add
