"""Where pressure goes when the riskiest cells are patrolled: hourly displacement and arrows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.functions.basics import bounded, dbl, ratio
from kerbflow.operators.ranking import position, top_per_group
from kerbflow.session import dealt, materialise


def patrolled_rows(patrol: DataFrame, share: float = 0.2) -> DataFrame:
    """Top share of each hour by patrol probability, at least one cell."""
    ranked = position(patrol.select("hour", "grid_cell_id", "patrol_probability"),
                      [("patrol_probability", False), ("grid_cell_id", True)], ["hour"])
    sizes = patrol.groupBy("hour").agg(F.count("*").alias("n"))
    quota = F.greatest(F.lit(1), F.floor(F.col("n") * dbl(share)))
    return ranked.join(F.broadcast(sizes), "hour").where(F.col("place") <= quota).select("hour", "grid_cell_id")


HOURS = 24  # of the day; an hour is a bit of a cell's masks


def hours_of(rows: DataFrame, name: str) -> DataFrame:
    """(grid_cell_id, ``name``): one row a cell, with the bits of the hours it has rows in."""
    return rows.groupBy("grid_cell_id").agg(F.expr("bit_or(shiftleft(1L, CAST(hour AS INT)))").alias(name))


def classes(patrolled: DataFrame, edges: DataFrame) -> DataFrame:
    """(grid_cell_id, hop0, hop1, hop2): the hours in which a cell is patrolled, or one or two steps from a patrolled cell.

    Steps are taken by cell for all hours at once, so they cost one row an edge, not one a patrolled cell, hour and path.
    """
    links = edges.select("src", F.col("dst").alias("grid_cell_id"))

    def step(masks: DataFrame, at: str, name: str) -> DataFrame:
        sent = masks.where(F.col(at) != 0).select(F.col("grid_cell_id").alias("src"), at)
        return links.join(dealt(sent), "src").groupBy("grid_cell_id").agg(F.bit_or(at).alias(name))

    def known(*names: str) -> list:
        return [F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in names]

    own = materialise(hours_of(patrolled, "hop0"), "patrolled-hours")
    first = own.join(dealt(step(own, "hop0", "hop1")), "grid_cell_id", "full").select("grid_cell_id", *known("hop0", "hop1"))
    first = materialise(first.withColumn("hop1", F.expr("hop1 & ~hop0")), "first-hops")
    both = first.join(dealt(step(first, "hop1", "hop2")), "grid_cell_id", "full").select("grid_cell_id", *known("hop0", "hop1", "hop2"))
    return both.withColumn("hop2", F.expr("hop2 & ~hop0 & ~hop1"))


def displaced(risk: DataFrame, patrolled: DataFrame, edges: DataFrame, eligible: DataFrame | None = None,
              keep: float = 0.8) -> DataFrame:
    """Adjusted risk per (cell, hour).

    Patrolled cells keep 80 % of their risk. What they lose goes to their neighbours (70 %) and
    second neighbours (30 %), limited to eligible cells where an hour has any. ``lost_risk`` is the
    hour's part that found no neighbour. The classes of a cell are one row for all hours and come to the risk rows by cell.
    """
    masks = classes(patrolled, edges)
    if eligible is None:
        masks = masks.withColumn("open", F.lit(-1).cast("bigint"))
    else:
        masks = masks.join(dealt(hours_of(eligible, "open")), "grid_cell_id", "left").fillna(0, ["open"])
    masks = materialise(masks, "classes")
    at = lambda mask: f"(shiftright({mask}, CAST(hour AS INT)) & 1) = 1"
    hop = F.expr(f"CASE WHEN {at('hop0')} THEN 0 WHEN {at('hop1')} THEN 1 WHEN {at('hop2')} THEN 2 END")
    hops = masks.withColumn("hour", F.explode(F.expr(f"filter(sequence(0, {HOURS - 1}), h -> shiftright(hop1 | hop2, h) & 1 = 1)")))
    hops = hops.select("hour", hop.alias("hop"), F.expr(f"IF({at('open')}, 1, 0)").alias("open"))

    def size(hop: int, only_open: bool):
        test = F.col("hop") == hop
        return F.count_if(test & (F.col("open") == 1) if only_open else test)

    counts = hops.groupBy("hour").agg(size(1, True).alias("open1"), size(1, False).alias("all1"),
                                      size(2, True).alias("open2"), size(2, False).alias("all2"))
    marked = risk.join(dealt(masks), "grid_cell_id", "left").select(
        "hour", "grid_cell_id", "cell_i", "cell_j", "grid_lat", "grid_lon", "risk_score", hop.alias("hop"), F.expr(f"IF({at('open')}, 1, 0)").alias("open"))
    marked = materialise(marked, "marked")
    loss = marked.where("hop = 0").groupBy("hour").agg(F.sum(F.col("risk_score") * dbl(1 - keep)).alias("total"))
    n1 = F.when(F.col("open1") > 0, F.col("open1")).otherwise(F.coalesce("all1", F.lit(0)))
    n2 = F.when(F.col("open2") > 0, F.col("open2")).otherwise(F.coalesce("all2", F.lit(0)))
    share1 = F.when((n1 > 0) & (n2 > 0), dbl(0.7)).when(n1 > 0, dbl(1.0)).otherwise(dbl(0.0))
    share2 = F.when((n1 > 0) & (n2 > 0), dbl(0.3)).when((n1 == 0) & (n2 > 0), dbl(1.0)).otherwise(dbl(0.0))
    hourly = loss.join(counts, "hour", "left").select(
        "hour", ratio(F.col("total") * share1, n1).alias("add1"), ratio(F.col("total") * share2, n2).alias("add2"),
        (F.coalesce("open1", F.lit(0)) > 0).alias("gate1"), (F.coalesce("open2", F.lit(0)) > 0).alias("gate2"),
        (F.col("total") * (dbl(1.0) - share1 - share2)).alias("lost_risk"))
    rows = marked.join(F.broadcast(hourly), "hour", "left")  # one row per hour
    takes1 = (F.col("hop") == 1) & ((F.col("open") == 1) | ~F.col("gate1"))
    takes2 = (F.col("hop") == 2) & ((F.col("open") == 1) | ~F.col("gate2"))
    kind = (F.when(F.col("hop") == 0, "patrolled").when(takes1, "neighbor_1").when(takes2, "neighbor_2")
            .otherwise("unaffected"))
    rows = rows.withColumn("spillover_type", kind)
    before = F.col("risk_score")
    after = bounded(
        F.when(F.col("spillover_type") == "patrolled", before * dbl(keep))
        .when(F.col("spillover_type") == "neighbor_1", before + F.col("add1"))
        .when(F.col("spillover_type") == "neighbor_2", before + F.col("add2"))
        .otherwise(before), 0.0, 100.0)
    return rows.withColumn("adjusted_risk", after).select(
        "grid_cell_id", "hour", "cell_i", "cell_j", "grid_lat", "grid_lon", before.alias("original_risk"),
        "adjusted_risk", "spillover_type",
        (ratio(F.col("adjusted_risk") - before, before) * dbl(100.0)).alias("risk_change_pct"),
        F.abs(F.col("adjusted_risk") - before).alias("magnitude"), "lost_risk")


def arrows(result: DataFrame, patrolled: DataFrame, edges: DataFrame, least: float = 0.1) -> DataFrame:
    """From the closest patrolled parent to each first neighbour that gained enough."""
    sent = dealt(hours_of(patrolled, "hours").withColumnRenamed("grid_cell_id", "src"))
    parents = edges.select("src", F.col("dst").alias("to_cell"), "dist").join(sent, "src").groupBy("to_cell").agg(
        F.collect_list(F.struct("dist", "src", "hours")).alias("parents"))  # as many as cells name this one among their nearest
    gained = result.where((F.col("spillover_type") == "neighbor_1") & (F.col("magnitude") > least)).select(
        "hour", F.col("grid_cell_id").alias("to_cell"), "magnitude")
    closest = F.expr("array_min(filter(parents, p -> shiftright(p.hours, CAST(hour AS INT)) & 1 = 1)).src")
    return gained.join(dealt(parents), "to_cell").select("hour", "to_cell", "magnitude", closest.alias("from_cell")).where("from_cell IS NOT NULL")


def top_arrows(found: DataFrame, limit: int = 50) -> DataFrame:
    """Largest arrows per hour; magnitudes are compared at 6 decimals so that ties go by id."""
    flat = found.withColumn("magnitude", F.round("magnitude", 6))
    return top_per_group(flat, ["hour"], [("magnitude", False), ("to_cell", True)], limit)


def summary(result: DataFrame) -> DataFrame:
    """Rows, share and mean change per class."""
    total = result.agg(F.count("*")).scalar()
    return result.groupBy("spillover_type").agg(
        F.count("*").alias("n"), F.avg("risk_change_pct").alias("mean_change_pct")).withColumn(
        "pct", F.col("n").cast("double") / total * dbl(100.0))
