"""The hour panel: sparse counts are shuffled, the panel stays in its slices of cells."""

import datetime

from kerbflow.operators import panel

AT = datetime.datetime(2024, 1, 1)
CELLS = [(0, 0), (0, 1), (1, 1), (5, 5)]


def counts(spark, more=()):
    rows = [(f"{i}_{j}", i, j, AT + datetime.timedelta(hours=h), n) for k, (i, j) in enumerate(CELLS) for h, n in ((0, 1), (k + 1, 2), (30 * k + 40, 3))]
    return spark.createDataFrame([*rows, *more], "grid_cell_id string, cell_i long, cell_j long, ts timestamp_ntz, violation_count long")


def above(plan, name):
    """Lines of a plan on the way from its root to the first node of this name."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    at = next(i for i, line in enumerate(lines) if name in line)
    found, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            found.append(line)
            level = depth(line)
    return found


def test_panel_is_not_shuffled(spark):
    cleaned = spark.createDataFrame([("0_0", 0.5, 0.5, "Junction 1")], "grid_cell_id string, vehicle_severity double, validation_trust double, junction_name string")
    plan = panel.feature_matrix(cleaned, counts(spark))._jdf.queryExecution().executedPlan().toString()
    way = above(plan, "Generate explode(sequence(")
    assert any("Window" in line for line in way) and any("Join" in line for line in way)
    assert not [line for line in way if "Exchange" in line]


def test_panel_and_spatial_lag_equal_a_loop(spark):
    odd = [(None, None, None, AT, 4), (None, None, None, None, 1), ("7_7", 7, 7, None, 5), ("9_9", 9, 9, None, 1), ("9_9", 9, 9, AT, 2)]
    table = counts(spark, odd)
    given = {(r.grid_cell_id, r.ts): r.violation_count for r in table.collect()}
    cells = {(r.grid_cell_id, r.cell_i, r.cell_j) for r in table.collect()}
    hours = [AT + datetime.timedelta(hours=h) for h in range(131)]
    got = [(r.grid_cell_id, r.ts, r.violation_count, r.spatial_lag_1) for r in panel.spatial_lag(panel.hour_panel(table), table).collect()]
    expected = []
    for name, i, j in cells:
        near = [other for other, a, b in cells if None not in (name, other) and other != name and abs(a - i) <= 1 and abs(b - j) <= 1]
        for ts in hours:
            sent = sum(given.get((other, ts - datetime.timedelta(hours=1)), 0) for other in near)
            expected.append((name, ts, given.get((name, ts), 0) if name else 0, sent / len(near) if near else 0.0))
    key = lambda r: (r[0] or "", *r[1:])
    assert sorted(got, key=key) == sorted(expected, key=key)
