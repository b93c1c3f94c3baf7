"""Spark session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Session with the settings the operators are tested under."""
    builder = (
        SparkSession.builder.master(master)
        .appName("kerbflow")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        root = tempfile.mkdtemp(prefix="kerbflow-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _LOCAL_ROOTS[app] = root
    return _LOCAL_ROOTS[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/kerbflow/{app}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where a table feeds more than one branch, so the fact scan below it runs once,
    the table survives executor loss, and the planner knows its real size.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled, never broadcast.

    Stored and shuffled tables are judged by their compressed size; where rows grow with the input, a few MB of them
    unfold to more than the driver holds.
    """
    return df.hint("merge")


def slices(spark: SparkSession) -> int:
    """Number of range slices for distributed ranking."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sources-")  # on the driver, which serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, f"{package.name}_main.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)
