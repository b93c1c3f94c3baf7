"""Exact density clustering (haversine DBSCAN) per group as block joins and graph contraction.

Points with equal coordinates are one weighted point. The cell side is eps / sqrt(2), so all points
of a cell are within eps of each other: a cell with enough weight is core without comparing pairs,
and core points of one cell share a cluster. Everything else compares boxes first and single points
only where a box straddles eps. Clusters are the components of the core-cell graph; a border point
takes the smallest label among the core points it reaches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbflow.functions import geo as G
from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import dbl
from kerbflow.session import dealt, materialise

EPS_DEGREES = 0.003  # fixed value
SPLIT = 8  # sub-cells per cell side and level


def _half_sine(degrees: Column) -> Column:
    return F.sin(F.radians(degrees) / 2)


def _limit(eps: float) -> float:
    return math.sin(math.radians(eps) / 2) ** 2


def _gap(a: str, b: str, axis: str) -> Column:
    return F.greatest(dbl(0.0), F.col(f"{b}.{axis}0") - F.col(f"{a}.{axis}1"), F.col(f"{a}.{axis}0") - F.col(f"{b}.{axis}1"))


def _span(a: str, b: str, axis: str) -> Column:
    return F.greatest(F.col(f"{a}.{axis}1") - F.col(f"{b}.{axis}0"), F.col(f"{b}.{axis}1") - F.col(f"{a}.{axis}0"))


def _near(a: str, b: str) -> Column:
    """Lower bound of the squared half chord between two boxes."""
    steep = F.greatest(*[F.abs(F.col(f"{s}.lat{e}")) for s in (a, b) for e in (0, 1)])
    up, across = _half_sine(_gap(a, b, "lat")), _half_sine(_gap(a, b, "lon")) * F.cos(F.radians(steep))
    return (up * up + across * across) * dbl(1 - 1e-9)


def _far(a: str, b: str) -> Column:
    """Upper bound of the squared half chord between two boxes."""
    low = F.least(*[F.abs(F.col(f"{s}.lat{e}")) for s in (a, b) for e in (0, 1)])
    level = F.when((F.col(f"{a}.lat0") <= 0) & (F.col(f"{a}.lat1") >= 0), dbl(1.0)).otherwise(F.cos(F.radians(low)))
    up, across = _half_sine(_span(a, b, "lat")), _half_sine(_span(a, b, "lon")) * level
    return (up * up + across * across) * dbl(1 + 1e-9)


def _exact(a: str, b: str) -> Column:
    up = _half_sine(F.col(f"{b}.lat") - F.col(f"{a}.lat"))
    across = _half_sine(F.col(f"{b}.lon") - F.col(f"{a}.lon"))
    return up * up + F.cos(F.radians(f"{a}.lat")) * F.cos(F.radians(f"{b}.lat")) * across * across


def gridded(df: DataFrame, group: str, eps: float) -> DataFrame:
    """Distinct weighted points with their cell and two levels of sub-cells."""
    side = eps / math.sqrt(2) * 0.999
    points = df.groupBy(group, F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(F.count("*").alias("w"))
    columns = {}
    for level, name in enumerate(("c", "s", "t")):
        step = side / SPLIT ** level
        columns[name] = F.concat_ws("_", G.lattice(F.col("lat"), step), G.lattice(F.col("lon"), step))
    indexed = points.withColumns({"ci": G.lattice(F.col("lat"), side), "cj": G.lattice(F.col("lon"), side), **columns})
    return indexed.withColumn("node", F.concat_ws("|", F.col(group).cast("string"), "c"))


def _around(df: DataFrame, eps: float) -> DataFrame:
    """One row per surrounding cell that may hold points within eps; the reach grows with latitude."""
    side = eps / math.sqrt(2) * 0.999
    reach = F.ceil(dbl(eps / side) / F.cos(F.radians(F.least(dbl(89.0), F.abs("lat") + dbl(2 * eps))))).cast("int")
    rows = df.withColumn("di", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn(
        "dj", F.explode(F.sequence(-reach, reach)))
    return rows.withColumns({"ni": F.col("ci") + F.col("di"), "nj": F.col("cj") + F.col("dj")}).drop("di", "dj")


def _boxes(points: DataFrame, group: str, *keys: str) -> DataFrame:
    return points.groupBy(group, *keys).agg(
        F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"),
        F.sum("w").alias("w"))


def _met_boxes(queries: DataFrame, points: DataFrame, group: str, eps: float) -> DataFrame:
    """Boxes near each query point, marked ``inside`` when wholly within eps."""
    boxes = _boxes(points, group, "ci", "cj", "node", "s").withColumnsRenamed({"ci": "ni", "cj": "nj", "node": "other"}).alias("b")
    asked = _around(queries.select(group, "lat", "lon", "ci", "cj"), eps).withColumns(
        {"lat0": F.col("lat"), "lat1": F.col("lat"), "lon0": F.col("lon"), "lon1": F.col("lon")}).alias("a")
    met = asked.join(dealt(boxes), [group, "ni", "nj"]).where(_near("a", "b") <= _limit(eps))
    return met.select(group, "a.lat", "a.lon", "b.other", "b.s", F.col("b.w").alias("w"), (_far("a", "b") <= _limit(eps)).alias("inside"))


def _met_points(partial: DataFrame, points: DataFrame, group: str, eps: float) -> DataFrame:
    """Single points of the straddling boxes that are within eps."""
    right = points.select(group, "s", "lat", "lon", "w", F.col("node").alias("other")).alias("q")
    left = partial.select(group, "s", "lat", "lon", "other").alias("p")
    joined = left.join(dealt(right), [group, "s", "other"]).where(_exact("p", "q") <= _limit(eps))
    return joined.select(group, "p.lat", "p.lon", "other", "q.w")


def core_points(points: DataFrame, group: str, eps: float, least: int) -> DataFrame:
    """Points with ``core`` set: weight within eps (itself included) of at least ``least``."""
    weights = points.groupBy("node").agg(F.sum("w").alias("cell_weight"))
    sized = materialise(points.join(dealt(weights), "node"), "sized-points")
    thin = sized.where(F.col("cell_weight") < least)
    met = materialise(_met_boxes(thin, sized, group, eps), "met-boxes")
    key = [group, "lat", "lon"]
    inside = met.groupBy(*key).agg(F.sum(F.when(F.col("inside"), F.col("w")).otherwise(0)).alias("sure"))
    open_ones = inside.where(F.col("sure") < least)
    partial = met.where(~F.col("inside")).join(dealt(open_ones.select(*key)), key, "left_semi")
    extra = _met_points(partial, sized, group, eps).groupBy(*key).agg(F.sum("w").alias("more"))
    total = inside.join(dealt(extra), key, "left").select(*key, (F.col("sure") + F.coalesce("more", F.lit(0))).alias("weight"))
    joined = sized.join(dealt(total), key, "left")
    core = (F.col("cell_weight") >= least) | (F.coalesce("weight", F.lit(0)) >= least)
    return joined.withColumn("core", core).drop("weight", "cell_weight")


def cell_edges(core: DataFrame, group: str, eps: float) -> DataFrame:
    """Pairs of core cells with two core points within eps, decided on boxes where possible."""
    cells = _boxes(core, group, "ci", "cj", "node")
    start = _around(cells.withColumn("lat", F.greatest(F.abs("lat0"), F.abs("lat1"))), eps).alias("a")
    other = cells.select(group, F.col("ci").alias("ni"), F.col("cj").alias("nj"), F.col("node").alias("other")).alias("b")
    pairs = start.join(dealt(other), [group, "ni", "nj"]).where(F.col("node") < F.col("other")).select(
        F.col("node").alias("src"), F.col("other").alias("dst"), F.col("node").alias("pa"), F.col("other").alias("pb"))
    found = None
    for parent, child in (("node", "s"), ("sk", "t")):
        keyed = core.withColumns({"sk": F.concat_ws("|", "node", "s"), "tk": F.concat_ws("|", "node", "t")})
        name = {"s": "sk", "t": "tk"}[child]
        boxes = _boxes(keyed, parent, name)
        left = boxes.select(F.col(parent).alias("pa"), F.col(name).alias("ka"), "lat0", "lat1", "lon0", "lon1").alias("a")
        right = boxes.select(F.col(parent).alias("pb"), F.col(name).alias("kb"), "lat0", "lat1", "lon0", "lon1").alias("b")
        met = pairs.join(dealt(left), "pa").join(dealt(right), "pb").where(_near("a", "b") <= _limit(eps)).select(
            "src", "dst", F.col("ka").alias("pa"), F.col("kb").alias("pb"), (_far("a", "b") <= _limit(eps)).alias("joined"))
        met = materialise(met, "box-pairs")
        sure = met.where("joined").select("src", "dst").distinct()
        found = sure if found is None else found.unionByName(sure)
        pairs = met.join(dealt(sure), ["src", "dst"], "left_anti").drop("joined")
    keyed = core.withColumn("tk", F.concat_ws("|", "node", "t"))
    left = keyed.select(F.col("tk").alias("pa"), "lat", "lon").alias("p")
    right = keyed.select(F.col("tk").alias("pb"), "lat", "lon").alias("q")
    last = pairs.join(dealt(left), "pa").join(dealt(right), "pb").where(_exact("p", "q") <= _limit(eps)).select("src", "dst").distinct()
    return found.unionByName(last)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each node: columns node, label.

    Each round hooks every root to its smallest neighbour, follows the pointers to their ends and
    contracts the graph, which at least halves the roots that still have edges.
    """
    labels = materialise(nodes.select("node", F.col("node").alias("label")), "labels")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = materialise(both.where("src <> dst").distinct(), "graph")
    while not both.isEmpty():
        hooks = materialise(both.where("dst < src").groupBy("src").agg(F.min("dst").alias("up")), "hooks")
        while True:
            step = hooks.alias("a").join(dealt(hooks).alias("b"), F.col("a.up") == F.col("b.src"), "left").select(
                F.col("a.src").alias("src"), F.coalesce("b.up", "a.up").alias("up"), F.col("b.up").isNotNull().alias("moved"))
            step = materialise(step, "hooks")
            hooks = step.select("src", "up")
            if step.where("moved").isEmpty():
                break
        moved = hooks.withColumnRenamed("src", "label")
        labels = materialise(labels.join(dealt(moved), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        for side in ("src", "dst"):
            both = both.join(dealt(hooks.select(F.col("src").alias(side), "up")), side, "left").withColumn(side, F.coalesce("up", side)).drop("up")
        both = materialise(both.where("src <> dst").select("src", "dst").distinct(), "graph")
    return labels


def labelled(df: DataFrame, group: str = "time_bucket", eps: float = EPS_DEGREES, least: int = 10) -> DataFrame:
    """Distinct points with weight, core flag and cluster label; noise has a null label."""
    points = materialise(gridded(df, group, eps), "grid-points")
    marked = materialise(core_points(points, group, eps, least), "core-points")
    core = marked.where("core")
    labels = components(core.select("node").distinct(), cell_edges(core, group, eps))
    inner = core.join(dealt(labels), "node").select(group, "lat", "lon", "w", "core", "label")
    loose = marked.where("NOT core")
    met = materialise(_met_boxes(loose, core, group, eps), "border-boxes")
    hits = met.where("inside").select(group, "lat", "lon", "other").unionByName(
        _met_points(met.where("NOT inside"), core, group, eps).select(group, "lat", "lon", "other"))
    border = hits.join(dealt(labels.withColumnRenamed("node", "other")), "other").groupBy(group, "lat", "lon").agg(F.min("label").alias("label"))
    outer = loose.join(dealt(border), [group, "lat", "lon"], "left").select(group, "lat", "lon", "w", "core", "label")
    return inner.unionByName(outer)


def bucket_shares(df: DataFrame) -> DataFrame:
    """Rows and share per cluster bucket with the sparse (< 5 %) and data-rich (>= 10 %) flags."""
    from kerbflow.functions.events import hour_label

    counted = materialise(
        df.groupBy(hour_label(F.col("hour"), V.CLUSTER_BUCKETS).alias("time_bucket")).agg(F.count("*").alias("n")), "bucket-counts")
    total = counted.agg(F.sum("n")).scalar()  # rows outside every bucket are part of the total
    share = F.col("n").cast("double") / total
    return counted.where(F.col("time_bucket").isNotNull()).select(
        "time_bucket", "n", share.alias("share"), F.when(share < 0.05, 1).otherwise(0).alias("is_sparse"),
        F.when(share >= 0.10, 1).otherwise(0).alias("is_data_rich"))


def records(events: DataFrame, points: DataFrame, shares: DataFrame) -> DataFrame:
    """One row per cluster: centre, size, box, most frequent junction, density.

    Coordinates are summed from weighted points; junctions are counted before they are ranked.
    """
    tagged = points.where(F.col("label").isNotNull())
    shape = tagged.groupBy("time_bucket", "label").agg(
        (F.sum(F.col("lat") * F.col("w")) / F.sum("w")).alias("centroid_lat"), (F.sum(F.col("lon") * F.col("w")) / F.sum("w")).alias("centroid_lon"),
        F.sum("w").alias("member_count"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"))
    counted = events.where(F.col("junction_name").isNotNull()).groupBy("time_bucket", "latitude", "longitude", "junction_name").agg(
        F.count("*").alias("n")).select("time_bucket", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "junction_name", "n")
    per_cluster = counted.join(dealt(tagged.select("time_bucket", "lat", "lon", "label")), ["time_bucket", "lat", "lon"]).groupBy(
        "time_bucket", "label", "junction_name").agg(F.sum("n").alias("n"))
    leading = per_cluster.groupBy("time_bucket", "label").agg(
        F.min(F.struct((-F.col("n")).alias("minus"), "junction_name")).getField("junction_name").alias("top_junction"))
    area = G.box_area_km2(F.col("lat0"), F.col("lat1"), F.col("lon0"), F.col("lon1"))
    joined = shape.join(dealt(leading), ["time_bucket", "label"], "left").join(shares.select("time_bucket", "is_data_rich"), "time_bucket")
    return joined.withColumns({"bbox_area_km2": area, "cluster_density": F.col("member_count") / area})


def summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("time_bucket").agg(
        F.count("*").alias("n_clusters"), F.sum("member_count").alias("total_members"), F.avg("member_count").alias("avg_members"),
        F.max("member_count").alias("max_members"), F.max("is_data_rich").alias("is_data_rich"))
