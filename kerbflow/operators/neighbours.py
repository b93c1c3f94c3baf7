"""Nearest neighbours by a balanced partition tree, and lattice neighbourhoods by equi-joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import geo as G
from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import dbl
from kerbflow.operators.ranking import position, top_per_group
from kerbflow.session import dealt, materialise, ship

MOORE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
LEAF = 64  # points of a leaf
FAN = 64  # children of a node
SIDES = (16, 64, 256)  # cells a side of the blocks that a search on the lattice tries in turn
PAIRS = 1 << 22  # distances that a block holds at once
SLACK = 1e-9  # bounds give way by this share, so rounding never rules a point out
_BOX = ("x0", "x1", "y0", "y1", "n")


def _axis(value: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Least and largest distance of a coordinate from an interval."""
    near = F.greatest(dbl(0.0), low - value, value - high)
    return near, F.greatest(F.abs(value - low), F.abs(value - high))


def _half_sine_squared(degrees: Column) -> Column:
    half = F.sin(F.radians(degrees) / 2)
    return half * half


def box_bounds(x: Column, y: Column, box: Column, haversine: bool) -> tuple[Column, Column]:
    """Lower and upper bound of the distance from a point to all points of a box."""
    (near_x, far_x), (near_y, far_y) = (_axis(v, box.getField(f"{c}0"), box.getField(f"{c}1")) for v, c in ((x, "x"), (y, "y")))
    if not haversine:
        return (near_x * near_x + near_y * near_y) * dbl(1 - SLACK), (far_x * far_x + far_y * far_y) * dbl(1 + SLACK)
    # Latitude x, longitude y. The chord grows with the longitude gap up to 180 degrees and shrinks beyond.
    steep = F.greatest(F.abs(box.getField("x0")), F.abs(box.getField("x1")))
    flat = F.when((box.getField("x0") <= 0) & (box.getField("x1") >= 0), dbl(0.0)).otherwise(F.least(F.abs(box.getField("x0")), F.abs(box.getField("x1"))))
    ends = (_half_sine_squared(near_y), _half_sine_squared(far_y))
    widest = F.when((near_y <= 180) & (far_y >= 180), dbl(1.0)).otherwise(F.greatest(*ends))
    own = F.cos(F.radians(x))
    low = _half_sine_squared(near_x) + own * F.cos(F.radians(steep)) * F.least(*ends)
    high = _half_sine_squared(F.least(far_x, dbl(180.0))) + own * F.cos(F.radians(flat)) * widest
    return G.chord_m(low) * dbl(1 - SLACK), G.chord_m(F.least(high, dbl(1.0))) * dbl(1 + SLACK)


def _strips(points: DataFrame, size: int) -> tuple[str, str, list[float]]:
    """Axis across the strips, axis along them, and the values of the first at which a new strip begins.

    Strips run along the axis on which the middle nine tenths of the points spread farther, and there are so many that
    a leaf is about as long as wide: points in a narrow band would else lie in long leaves, of which a query meets many.
    """
    ends = points.agg(*[F.percentile_approx(c, [0.05, 0.5, 0.95]).alias(c) for c in "xy"]).first()
    wide = {c: ends[c][2] - ends[c][0] if ends[c] else 0.0 for c in "xy"}
    if ends["x"]:
        wide["y"] *= math.cos(math.radians(ends["x"][1]))
    across, along = ("x", "y") if wide["x"] <= wide["y"] else ("y", "x")
    share = wide[across] / wide[along] if wide[along] > 0 else 1.0
    count = math.ceil(math.sqrt(size / LEAF * share)) if share == share else 1
    if count <= 1:
        return across, along, []
    cuts = points.agg(F.percentile_approx(across, [i / count for i in range(1, count)])).first()[0]
    return across, along, sorted(set(cuts))


def tree(points: DataFrame, size: int, haversine: bool = False) -> tuple[DataFrame, list[tuple[DataFrame, str]]]:
    """Points with their leaf (strip, tile), and the node levels from the leaves up to at most ``FAN`` nodes.

    Strips are ranges of one axis and tiles runs of ``LEAF`` rows of a strip along the other, then by id, so a leaf has
    at most ``LEAF`` points even where many of them coincide. Flat strips are ranges of (x, id): the leaf of a point
    without coordinates decides which queries meet it. A level is a table of strip, tile, box and number of points
    with the axis along which ``FAN`` of its nodes share a parent.
    """
    if haversine:
        across, along, cuts = _strips(points, size)
        strip = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(across))) if cuts else F.lit(0)
        spread = points.select("id", "x", "y", strip.alias("strip"))
        placed = position(spread, [(along, True), ("id", True)], ["strip"])  # no strip lies in one task
    else:
        strips = max(1, math.ceil(math.sqrt(size / LEAF)))
        spread = points.select("id", "x", "y").repartitionByRange(strips, "x", "id").withColumn("strip", F.spark_partition_id())
        placed = spread.withColumn("place", F.row_number().over(Window.partitionBy("strip").orderBy("y", "id")))
    placed = materialise(placed.withColumn("tile", F.floor((F.col("place") - 1) / LEAF).cast("int")).drop("place"), "tree-points")
    nodes = materialise(placed.groupBy("strip", "tile").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")), "tree-leaves")
    strips, tiles = (1 + (edge or 0) for edge in nodes.agg(F.max("strip"), F.max("tile")).first())
    levels = []
    while True:
        axis = "tile" if tiles > 1 else "strip"
        levels.append((nodes, axis))
        if strips * tiles <= FAN:
            return placed, levels
        strips, tiles = (strips, math.ceil(tiles / FAN)) if axis == "tile" else (math.ceil(strips / FAN), tiles)
        nodes = _with_parent(nodes, axis).groupBy(F.col("up_strip").alias("strip"), F.col("up_tile").alias("tile")).agg(
            F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("n").alias("n"))


def _with_parent(nodes: DataFrame, axis: str) -> DataFrame:
    return nodes.withColumns({f"up_{c}": F.floor(F.col(c) / FAN).cast("int") if c == axis else F.col(c) for c in ("strip", "tile")})


def _pruned(rows: DataFrame, need: int, haversine: bool) -> DataFrame:
    """Of the nodes beside each query, those that may hold one of its ``need`` nearest points."""
    low, high = box_bounds(F.col("qx"), F.col("qy"), F.struct(*_BOX), haversine)
    rated = rows.select("src", "qx", "qy", "strip", "tile", "n", low.alias("low"), high.alias("high"))
    one = Window.partitionBy("src")  # FAN children of a few nodes
    seen = F.sum("n").over(one.orderBy("high", "strip", "tile"))
    bound = F.min(F.when(F.col("seen") >= need, F.col("high"))).over(one)
    kept = rated.withColumn("seen", seen).withColumn("bound", bound).where("bound IS NULL OR low <= bound")
    return kept.select("src", "qx", "qy", "strip", "tile", "low")


def candidate_leaves(queries: DataFrame, levels: list[tuple[DataFrame, str]], need: int, haversine: bool) -> DataFrame:
    """(src, qx, qy, strip, tile, low): leaves that may hold one of a query's ``need`` nearest points, with their lower bound."""
    top = levels[-1][0].agg(F.collect_list(F.struct("strip", "tile", *_BOX))).scalar()  # at most FAN boxes
    asked = queries.select(F.col("id").alias("src"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.explode(top).alias("node"))
    rows = _pruned(asked.select("src", "qx", "qy", "node.*"), need, haversine)
    for nodes, axis in reversed(levels[:-1]):
        opened = rows.select("src", "qx", "qy", F.col("strip").alias("up_strip"), F.col("tile").alias("up_tile"))
        rows = _pruned(opened.join(_with_parent(nodes, axis), ["up_strip", "up_tile"]), need, haversine)
    return rows


def _families(nodes: DataFrame, axis: str) -> DataFrame:
    """One row a parent: its at most ``FAN`` nodes as an array."""
    return _with_parent(nodes, axis).groupBy("up_strip", "up_tile").agg(F.collect_list(F.struct("strip", "tile", *_BOX)).alias("nodes"))


def _descend(rows: DataFrame, levels: list[tuple[DataFrame, str]], chosen: Callable[[Column], Column], keep: Sequence[str]) -> DataFrame:
    """Leaves met by rows of (src, qx, qy, ...) when from the nodes of a parent those of the array ``chosen`` are followed."""
    top = levels[-1][0].agg(F.collect_list(F.struct("strip", "tile", *_BOX)).alias("nodes"))  # one row of at most FAN boxes
    rows = rows.crossJoin(F.broadcast(top)).select(*keep, F.explode(chosen(F.col("nodes"))).alias("node")).select(*keep, "node.strip", "node.tile")
    for nodes, axis in reversed(levels[:-1]):
        opened = rows.withColumnsRenamed({"strip": "up_strip", "tile": "up_tile"}).join(_families(nodes, axis), ["up_strip", "up_tile"])
        rows = opened.select(*keep, F.explode(chosen(F.col("nodes"))).alias("node")).select(*keep, "node.strip", "node.tile")
    return rows


def nearest(queries: DataFrame, targets: DataFrame, k: int, haversine: bool = False) -> DataFrame:
    """k nearest targets of each query as (src, dst, place, dist); a query never finds its own id.

    Inputs have ``id, x, y``, ids are unique. A query first reads the leaf at the end of the nearest boxes, then only
    leaves within the k-th distance found there; one that finds fewer than k there descends by bounds alone. ``dist``
    is the squared flat distance, or metres with ``haversine``.
    """
    pool = materialise(targets.select("id", "x", "y"), "knn-targets")
    placed, levels = tree(pool, pool.count(), haversine)
    leaves = materialise(placed.groupBy("strip", "tile").agg(F.collect_list(F.struct("id", "x", "y")).alias("points")), "knn-points")
    asked = queries.select(F.col("id").alias("src"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    low = lambda node: box_bounds(F.col("qx"), F.col("qy"), node, haversine)[0]

    def read(rows: DataFrame, reach: Column | None = None) -> DataFrame:
        """The k nearest points of each leaf met, of those within ``reach``."""
        def rated(p: Column) -> Column:
            dx, dy = p.getField("x") - F.col("qx"), p.getField("y") - F.col("qy")
            dist = G.haversine_m(F.col("qx"), F.col("qy"), p.getField("x"), p.getField("y")) if haversine else dx * dx + dy * dy
            return F.struct(dist.alias("dist"), p.getField("id").alias("dst"))
        pairs = F.transform(F.filter("points", lambda p: p.getField("id") != F.col("src")), rated)
        pairs = pairs if reach is None else F.filter(pairs, lambda p: reach.isNull() | p.getField("dist").isNull() | (p.getField("dist") <= reach))
        met = rows.join(dealt(leaves), ["strip", "tile"])
        return met.select("src", F.explode(F.slice(F.array_sort(pairs), 1, k)).alias("pair")).select("src", "pair.dst", "pair.dist")

    def closest(nodes: Column) -> Column:
        best = F.array_min(F.transform(nodes, lambda n: F.struct(low(n).alias("low"), n.getField("strip").alias("strip"), n.getField("tile").alias("tile"))))
        return F.filter(F.array(best), lambda n: n.isNotNull())

    base = ["src", "qx", "qy"]
    home = materialise(_descend(asked, levels, closest, base), "knn-home")
    first = materialise(read(home), "knn-first")
    reach = first.groupBy("src").agg(F.when(F.count("*") == k, F.max("dist")).alias("reach"))
    known = materialise(home.withColumnsRenamed({"strip": "home_strip", "tile": "home_tile"}).join(dealt(reach), "src", "left"), "knn-reach")
    near = _descend(known.where("reach IS NOT NULL"), levels, lambda nodes: F.filter(nodes, lambda n: low(n) <= F.col("reach")), [*base, "reach", "home_strip", "home_tile"])
    loose = known.where("reach IS NULL").select("src", "home_strip", "home_tile")
    few = asked.withColumnsRenamed({"src": "id", "qx": "x", "qy": "y"}).join(loose.select(F.col("src").alias("id")), "id", "left_semi")
    wide = candidate_leaves(few, levels, k + 1, haversine).drop("low").join(loose, "src").withColumn("reach", F.lit(None).cast("double"))
    rest = near.unionByName(wide).where("NOT (strip = home_strip AND tile = home_tile)")
    both = first.unionByName(read(rest, F.col("reach")))
    return top_per_group(both, ["src"], [("dist", True), ("dst", True)], k)


def _block_search(k: int, side: int):
    """For the cells of a block that ask: their k nearest among the cells of the 3 x 3 blocks around, or a row of place 0."""
    def run(table: pa.Table) -> pa.Table:
        asked, held = table.filter(table["asks"]), table.filter(pc.invert(table["asks"])).sort_by("id")
        size, found = held.num_rows, []
        x, y, qx, qy = (np.asarray(t[c]) for t in (held, asked) for c in ("x", "y"))
        own = np.asarray(pc.index_in(asked["id"], value_set=held["id"].combine_chunks()))
        ranks = np.arange(size)  # of equal distances the smaller id comes first
        for first in range(0, asked.num_rows, max(1, PAIRS // max(1, size))):
            rows = np.arange(first, min(asked.num_rows, first + max(1, PAIRS // max(1, size))))
            sure = np.zeros(len(rows), dtype=bool)
            if size > k:
                key = ((qx[rows, None] - x) ** 2 + (qy[rows, None] - y) ** 2) * size + ranks
                key[np.arange(len(rows)), own[rows]] = np.iinfo(np.int64).max
                best = np.sort(np.partition(key, k - 1, axis=1)[:, :k], axis=1)
                inside = [q[rows] % side for q in (qx, qy)]
                gap = np.minimum.reduce([side + 1 + inside[0], 2 * side - inside[0], side + 1 + inside[1], 2 * side - inside[1]])  # to cells outside the blocks
                sure = best[:, -1] // size < gap * gap
                best = best[sure].ravel()
                found.append((np.repeat(rows[sure], k), best % size, best // size, np.tile(np.arange(1, k + 1), int(sure.sum()))))
            left = rows[~sure]
            found.append((left, np.full(len(left), -1), np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)))
        src, dst, dist, place = (np.concatenate(part) if found else np.zeros(0, np.int64) for part in (zip(*found) if found else [()] * 4))
        taken = pa.array(dst, mask=dst < 0)
        return pa.table({"src": asked["id"].take(pa.array(src)), "dst": held["id"].take(taken), "dist": pa.array(dist.astype(np.float64)),
                         "place": pa.array(place.astype(np.int32)), "x": pa.array(qx[src]), "y": pa.array(qy[src])})
    return run


def _by_blocks(asked: DataFrame, pool: DataFrame, k: int, side: int, everywhere: bool) -> DataFrame:
    """Stored (src, dst, dist, place, x, y): the k nearest cells of those whose 3 x 3 blocks settle them, place 0 for the others.

    A block holds at most ``side`` x ``side`` cells, as ids stand for coordinates, so no task meets more however cells lie.
    """
    block = lambda c, step=0: F.expr(f"(`{c}` - pmod(`{c}`, {side})) div {side}") + step
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = pool.withColumn("step", F.explode(steps)).select("id", "x", "y", block("x", F.col("step.i")).alias("bx"), block("y", F.col("step.j")).alias("by"), F.lit(False).alias("asks"))
    asking = asked.select("id", "x", "y", block("x").alias("bx"), block("y").alias("by"), F.lit(True).alias("asks"))
    if not everywhere:
        near = near.join(dealt(asking.select("bx", "by").distinct()), ["bx", "by"], "left_semi").select(asking.columns)
    rows = near.unionByName(asking).groupBy("bx", "by")
    return materialise(rows.applyInArrow(_block_search(k, side), "src string, dst string, dist double, place int, x long, y long"), "knn-blocks")


def cell_graph(cells: DataFrame, k: int = 6) -> DataFrame:
    """k-nearest-neighbour edges between lattice cells; distances are exact integers.

    Cells look around in blocks of growing sides; one with fewer than k cells about as near as the largest side descends
    the partition tree. Where a cell has no coordinates, all do, as its leaf decides who meets it.
    """
    pool = materialise(cells.select(F.col("grid_cell_id").cast("string").alias("id"), F.col("cell_i").cast("bigint").alias("x"), F.col("cell_j").cast("bigint").alias("y")), "knn-cells")
    flat = lambda df: df.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if not pool.where("id IS NULL OR x IS NULL OR y IS NULL").isEmpty():
        return nearest(flat(pool), flat(pool), k)
    ship(pool.sparkSession)
    asked, edges = pool, None
    for side in SIDES:
        found = _by_blocks(asked, pool, k, side, asked is pool)
        settled = found.where("place > 0").select("src", "dst", "dist", "place")
        edges = settled if edges is None else edges.unionByName(settled)
        asked = found.where("place = 0").select(F.col("src").alias("id"), "x", "y")
        if asked.isEmpty():
            return edges
    return edges.unionByName(nearest(flat(asked), flat(pool), k))


def zone_points(zones: DataFrame) -> DataFrame:
    return zones.select(F.col("zone_id").alias("id"), F.col("lat").alias("x"), F.col("lon").alias("y"))


def zone_graph(zones: DataFrame, k: int = 6) -> DataFrame:
    """k nearest zones by great-circle distance."""
    points = zone_points(zones)
    return nearest(points, points, k, haversine=True)


def by_travel_time(candidates: DataFrame, times: DataFrame, k: int) -> DataFrame:
    """Re-rank candidate edges by a supplied (src, dst, seconds) table; keep the k fastest."""
    timed = candidates.drop("place").join(times, ["src", "dst"])
    return top_per_group(timed, ["src"], [("seconds", True), ("dst", True)], k)


def moore_edges(cells: DataFrame) -> DataFrame:
    """Edges to the present cells among the eight surrounding ones; an equi-join on lattice indices."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in MOORE])
    out = cells.select(F.col("grid_cell_id").alias("src"), "cell_i", "cell_j", F.explode(steps).alias("step"))
    out = out.select("src", (F.col("cell_i") + F.col("step.i")).alias("cell_i"),
                     (F.col("cell_j") + F.col("step.j")).alias("cell_j"))
    return out.join(cells.select(F.col("grid_cell_id").alias("dst"), "cell_i", "cell_j"), ["cell_i", "cell_j"]).select(
        "src", "dst")


def second_hop(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Cells two hops from the sources that are neither sources nor one hop away."""
    first = edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi").select(
        F.col("dst").alias("id")).distinct()
    first = first.join(sources.select("id"), "id", "left_anti")
    second = edges.join(first.select(F.col("id").alias("src")), "src", "left_semi").select(
        F.col("dst").alias("id")).distinct()
    return second.join(sources.select("id"), "id", "left_anti").join(first, "id", "left_anti")
