"""One-document JSON files against the json module, read in small splits."""

import json
import random

import pytest

from kerbflow.session import shared_path
from kerbflow.sources import documents, readers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def values(seed, n):
    pick = random.Random(seed)
    texts = ["", "a,b", 'q"uote', "back\\slash\\", "{[", "]},", "\\\",{", "ü,日", "line\nend", "tail\\\\\","]
    return [{"zone": pick.choice(texts), "list": [pick.choice(texts) for _ in range(pick.randint(0, 3))], "deep": {"n": pick.randint(0, 99), "t": {"x": pick.choice(texts)}}} for _ in range(n)]


def write(spark, text, name):
    folder = shared_path(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(folder)
    return folder


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_and_objects(small_splits, indent):
    spark = small_splits
    rows = values(1, 60)
    found = documents.objects(spark, write(spark, json.dumps(rows, indent=indent), "array"))
    assert found.sparkSession.read.text(write(spark, json.dumps(rows, indent=indent), "again"), lineSep=",").rdd.getNumPartitions() > 5
    assert sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in found.collect()) == sorted(json.dumps(r, sort_keys=True) for r in rows)
    keyed = {f"k{i},\"{{": row for i, row in enumerate(values(2, 40))}
    path = write(spark, json.dumps(keyed, indent=indent, ensure_ascii=False), "object")
    got = {}
    for r in documents.keyed(spark, path).collect():
        got |= json.loads(r.value)
    assert got == keyed
    assert [json.loads(r.value) for r in documents.objects(spark, path).collect()] == [keyed]


@pytest.mark.parametrize("text", ["{}", "[]", " [ ] ", "{\n}"])
def test_empty_documents(spark, text):
    assert documents.entries(spark, write(spark, text, "empty")).collect() == []


def test_events_and_maps_equal_the_line_form(small_splits):
    spark = small_splits
    events = [{"id": str(i), "latitude": i / 7, "violation_type": '["A","B"]', "location": "x, {y}"} for i in range(30)]
    lines, document = write(spark, "\n".join(map(json.dumps, events)), "lines"), write(spark, json.dumps(events), "document")
    assert sorted(readers.read_events(document, spark, "json").collect()) == sorted(readers.read_events(lines, spark, "jsonl").collect())
    ratios = {f"z{i}": {"travel_time_ratio": 1 + i / 10, "note": "a,b"} for i in range(20)} | {"none": None, "bad": {"travel_time_ratio": -1}}
    found = readers.travel_ratios(spark, write(spark, json.dumps(ratios), "map"), whole=True)
    assert sorted((r.zone_id, r.travel_time_ratio) for r in found.collect()) == sorted((k, v["travel_time_ratio"]) for k, v in ratios.items() if v and v["travel_time_ratio"] > 0)


def test_fragments_are_neither_stored_nor_shuffled(spark, monkeypatch):
    """Only entries and a few rows a block are stored, however many commas an entry has."""
    stored = []
    keep = documents.materialise

    def counting(df, label):
        table = keep(df, label)
        stored.append(table.count())
        return table

    monkeypatch.setattr(documents, "materialise", counting)
    rows = [{f"k{j}": f'{i},"{j}' for j in range(30)} for i in range(100)]
    found = documents.objects(spark, write(spark, json.dumps(rows), "wide")).collect()
    assert sorted(json.dumps(json.loads(r.value)) for r in found) == sorted(map(json.dumps, rows))
    assert sum(stored) < 200  # 3,000 commas


def test_entries_across_blocks_keep_their_number(small_splits):
    spark = small_splits
    rows = [1, "a,b]", ["x" * 700, "\\", '"'], {"k": "y," * 300}, None, [], "\\\"", *range(200)]
    path = write(spark, " \n" + json.dumps(rows), "numbered")
    got = sorted((r.number, json.loads(r.entry), r.is_array, r.file.startswith("file:")) for r in documents.entries(spark, path).collect())
    assert [g[0] for g in got] == list(range(len(rows))) and [g[1] for g in got] == rows and all(g[2] and g[3] for g in got)
