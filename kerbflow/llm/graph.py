"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v); nodes share a label exactly if they are connected.

    In each round a node joins the neighbour (or itself) that comes first in a random order of the round, and edges
    are rewritten to what their ends joined; a fixed share of the nodes is expected to vanish in each round. Minima
    are combined before they are shuffled and joins leave one side unique, so a hub is no hot key that cannot be split.
    """
    edges = materialise(edges.where("u <> v").select("u", "v"), "graph-edges")
    labels, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        joined = materialise(both.groupBy("u").agg(F.least(F.min(order("v")), F.first(order("u"))).alias("first")).select(F.col("u").alias("node"), F.col("first.id").alias("label")), "graph-joined")
        if labels is None:
            labels = joined
        else:
            moved = joined.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = materialise(labels.join(moved, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "graph-labels")
        ends = edges.join(joined.select(F.col("node").alias("u"), F.col("label").alias("a")), "u").join(joined.select(F.col("node").alias("v"), F.col("label").alias("b")), "v")
        edges = materialise(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "graph-edges")
        turn += 1
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels
