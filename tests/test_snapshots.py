import pytest

from kerbflow.session import shared_path
from kerbflow.sources import sinks


def test_snapshot_is_written_once_and_checked_on_read(spark):
    path = shared_path(spark, "snapshot")
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5), ("b", 2, 0.5)], "zone_id string, n int, x double")
    columns = ["zone_id", "n", "x"]
    assert sinks.provenance(spark, path).first().frozen == 0
    with pytest.raises(FileNotFoundError):
        sinks.read_frozen(spark, path)
    made = sinks.freeze(rows, path, columns, "a test").first()
    assert (made.n, made.source, made.frozen) == (3, "a test", 1)
    with pytest.raises(FileExistsError):
        sinks.freeze(rows.limit(1), path, columns)
    assert sorted(map(tuple, sinks.read_frozen(spark, path).na.fill(0).collect())) == [("a", 1, 0.0), ("b", 2, 0.5), ("b", 2, 0.5)]


@pytest.mark.parametrize("change", [[("a", 1)], [("a", 1), ("b", 3)], [("a", 1), ("b", 2), ("b", 2)], []])
def test_changed_data_is_refused(spark, change):
    path = shared_path(spark, "snapshot")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "zone_id string, n int")
    sinks.freeze(rows, path, rows.columns)
    data = sinks._manifest(spark, path).data
    spark.createDataFrame(change, rows.schema).write.mode("overwrite").parquet(f"{path}/{data}")
    with pytest.raises(ValueError):
        sinks.read_frozen(spark, path)
