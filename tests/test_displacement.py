"""Hop classes and shares of the displacement against plain loops."""

import random

import pytest

from kerbflow.operators import displacement


def plain(risk, hot, edges, eligible):
    out = {}
    for hour in {h for h, _ in risk}:
        hit = {c for h, c in hot if h == hour}
        one = {d for s, d in edges if s in hit} - hit
        two = {d for s, d in edges if s in one} - hit - one
        sets = []
        for cells in (one, two):
            free = {c for c in cells if (hour, c) in eligible}
            sets.append(free or cells)
        total = sum(risk[hour, c] * 0.2 for c in hit if (hour, c) in risk)
        shares = [(0.7, 0.3), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)][(not sets[1]) + 2 * (not sets[0])]
        for h, c in risk:
            if h == hour:
                kind = "patrolled" if c in hit else "neighbor_1" if c in sets[0] else "neighbor_2" if c in sets[1] else "unaffected"
                value = risk[h, c]
                after = value * 0.8 if kind == "patrolled" else value + total * shares[0] / len(sets[0]) if kind == "neighbor_1" else value + total * shares[1] / len(sets[1]) if kind == "neighbor_2" else value
                out[h, c] = (kind, min(100.0, after), total * (1 - sum(shares)))
    return out


def test_against_loops(spark):
    pick = random.Random(3)
    cells = [f"c{i:02d}" for i in range(40)]
    edges = [(a, b) for a in cells[:30] for b in pick.sample(cells, 3) if a != b]  # ten cells have no edges of their own
    risk = {(h, c): pick.uniform(0, 60) for h in range(4) for c in cells if pick.random() < 0.9}
    hot = [(h, c) for h in range(3) for c in pick.sample(cells[:30], 4)] + [(3, "c39")]  # hour 3 loses what nobody takes
    eligible = {(h, c) for h in (0, 3) for c in cells if pick.random() < 0.3}
    spot = "grid_cell_id string, cell_i int, cell_j int, grid_lat double, grid_lon double"
    rows = spark.createDataFrame([(h, c, 0, 0, 0.0, 0.0, v) for (h, c), v in risk.items()], f"hour int, {spot}, risk_score double")
    frame = lambda values: spark.createDataFrame(values, "hour int, grid_cell_id string")
    links = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, dist double")
    got = displacement.displaced(rows, frame(hot), links, frame(sorted(eligible))).collect()
    expected = plain(risk, hot, edges, eligible)
    assert len(got) == len(expected) and {r.spillover_type for r in got} == {"patrolled", "neighbor_1", "neighbor_2", "unaffected"}
    for r in got:
        kind, after, lost = expected[r.hour, r.grid_cell_id]
        assert r.spillover_type == kind and r.adjusted_risk == pytest.approx(after) and r.lost_risk == pytest.approx(lost, abs=1e-9)
    assert any(r.lost_risk > 1 for r in got) == ((3, "c39") in risk)


def test_arrows_come_from_the_closest_patrolled_cell_and_classes_have_a_row_a_cell(spark):
    pick = random.Random(4)
    cells = [f"c{i:02d}" for i in range(30)]
    edges = [(a, b, float(pick.randint(1, 3))) for a in cells for b in pick.sample(cells, 4) if a != b]
    hot = [(h, c) for h in (0, 9, 23) for c in pick.sample(cells, 5)]
    frame = lambda values, schema: spark.createDataFrame(values, schema)
    patrolled, links = frame(hot, "hour int, grid_cell_id string"), frame(edges, "src string, dst string, dist double")
    gained = frame([(h, c, "neighbor_1", 0.2) for h in (0, 5, 9, 23) for c in cells], "hour int, grid_cell_id string, spillover_type string, magnitude double")
    expected = {}
    for h, c in hot:
        for s, d, dist in edges:
            if s == c:
                expected[h, d] = min(expected.get((h, d), (dist, s)), (dist, s))
    got = displacement.arrows(gained, patrolled, links).collect()
    assert {(r.hour, r.to_cell): r.from_cell for r in got} == {key: s for key, (_, s) in expected.items()} and len(got) == len(expected)
    found = displacement.classes(patrolled, links).collect()
    assert len(found) == len({r.grid_cell_id for r in found}) <= len(cells)
