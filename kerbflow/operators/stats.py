"""Rank correlation, bootstrap intervals, precision at k and error metrics, all grouped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import dbl, half_up, ratio
from kerbflow.operators.ranking import average_rank, position, top_per_group
from kerbflow.session import materialise

MIN_POINTS = 5  # fixed value: fewer pairs give null


def spearman(pairs: DataFrame, group: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Rank correlation with average ranks per group: columns group..., n, rho.

    Rows are first counted per distinct (x, y); ranks are built from distinct values, so ties of
    any size cost one row. Null for fewer than five pairs or a constant side.
    """
    keys = list(group)
    counted = materialise(pairs.groupBy(*keys, x, y).agg(F.count("*").alias("n")), "pairs")
    rank_x = average_rank(counted.groupBy(*keys, x).agg(F.sum("n").alias("n")), x, keys, "n", "rx").drop("n")
    rank_y = average_rank(counted.groupBy(*keys, y).agg(F.sum("n").alias("n")), y, keys, "n", "ry").drop("n")
    ranked = counted.join(rank_x, [*keys, x]).join(rank_y, [*keys, y])
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("size"))
    return rank_correlation(ranked.join(sizes, keys), keys, "n").withColumnRenamed("size", "n")


def rank_correlation(ranked: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Correlation of ``rx`` and ``ry`` around their known mean (size + 1) / 2."""
    middle = (F.col("size") + 1) / F.lit(2.0)
    dx, dy, w = F.col("rx") - middle, F.col("ry") - middle, F.col(weight)
    sums = ranked.groupBy(*keys).agg(
        F.max("size").alias("size"), F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"),
        F.sum(w * dy * dy).alias("yy"))
    return sums.select(*keys, "size", _rho().alias("rho"))


def _rho() -> Column:
    """Correlation from ``size, xy, xx, yy``; null for too few rows or a constant side."""
    defined = (F.col("size") >= MIN_POINTS) & (F.col("xx") > 0) & (F.col("yy") > 0)
    return F.when(defined, F.col("xy") / F.sqrt(F.when(defined, F.col("xx") * F.col("yy"))))


def pearson(pairs: DataFrame, group: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    sums = pairs.groupBy(*group).agg(
        F.count("*").alias("n"), F.corr(x, y).alias("r"), F.min(x).alias("x0"), F.max(x).alias("x1"),
        F.min(y).alias("y0"), F.max(y).alias("y1"))
    defined = (F.col("n") >= MIN_POINTS) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return sums.select(*group, "n", F.when(defined, F.col("r")).alias("r"))


def bootstrap(pairs: DataFrame, group: str, ident: str, n_boot: int = 2000, seed: int = V.BOOTSTRAP_SEED,
              level: float = 0.95) -> DataFrame:
    """Percentile interval of Spearman per group; pairs are (group, ident, x, y).

    Resamples are drawn and ranked inside tasks, block against block; only sums per resample leave them.
    """
    from kerbflow.operators.blocked import resample_correlations

    rows = position(pairs.select(group, ident, "x", "y"), [(ident, True)], [group], "slot")
    sums = resample_correlations(rows.withColumn("slot", F.col("slot") - 1), group, n_boot, seed)
    each = materialise(sums.withColumn("rho", _rho()).select(group, "boot", "size", "rho"), "boot-rho")
    drawn = each.where("boot >= 0 AND rho IS NOT NULL").withColumn("rho", F.round("rho", 9))
    tail = (1 - level) / 2
    merged = drawn.groupBy(group).agg(
        F.count("*").alias("valid"), F.percentile("rho", F.array(dbl(tail), dbl(1 - tail))).alias("ends"),
        F.avg(F.when(F.col("rho") <= 0, 1.0).otherwise(0.0)).alias("low_share"),
        F.avg(F.when(F.col("rho") >= 0, 1.0).otherwise(0.0)).alias("high_share"))
    enough = F.col("valid") >= max(20, n_boot // 10)
    ends = merged.select(
        group, F.when(enough, F.get("ends", F.lit(0))).alias("lo"), F.when(enough, F.get("ends", F.lit(1))).alias("hi"),
        F.when(enough, F.least(dbl(1.0), dbl(2.0) * F.least("low_share", "high_share"))).alias("p_approx"))
    point = each.where("boot = -1").select(group, F.col("size").alias("n"), "rho")
    return point.join(ends, group, "left").withColumns({
        name: F.when(F.col("rho").isNotNull(), F.col(name)) for name in ("lo", "hi", "p_approx")})


def flat_variance(values: DataFrame, column: str, least: float = 0.02) -> DataFrame:
    """Spread of the measured ratios and whether it is too small to calibrate on."""
    sums = values.agg(F.count(column).alias("n"), F.coalesce(F.stddev_pop(column), dbl(0.0)).alias("std"))
    return sums.withColumn("status", F.when((F.col("n") == 0) | (F.col("std") < least), "aborted_flat_variance").otherwise("ok"))


def strength(n: Column, rho: Column, low: Column, baseline: Column) -> Column:
    """Verdict on the non-circular correlation."""
    missing = (n < MIN_POINTS) | rho.isNull() | low.isNull()
    return F.when(missing, "aborted").when(
        (low > F.coalesce(baseline, dbl(0.0))) & (rho > 0.3), "strong").otherwise("weak")


def errors(df: DataFrame, actual: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R2 from one aggregate; negative predictions count as zero."""
    a = F.col(actual).cast("double")
    miss = F.greatest(F.col(predicted).cast("double"), dbl(0.0)) - a
    sums = df.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(F.abs(miss)).alias("mae"), F.avg(miss * miss).alias("mse"),
        F.var_pop(a).alias("spread"))
    return sums.select(*group, "n", "mae", F.sqrt("mse").alias("rmse"),
                       F.when(F.col("spread") > 0, dbl(1.0) - ratio(F.col("mse"), F.col("spread"), None)).alias("r2"))


def precision_at_k(df: DataFrame, group: Sequence[str], ident: str, actual: str, predicted: str, k: int = 10,
                   also: Sequence[str] = (), skip_empty: bool = False) -> DataFrame:
    """Mean over groups of the overlap of the two top-k sets; groups with fewer than k ids are left out.

    ``also`` are outer keys (for instance a blend weight) kept in the result.
    """
    outer, inner = list(also), [*also, *group]
    sizes = df.groupBy(*inner).agg(F.count("*").alias("ids"), F.sum(actual).alias("total"))
    use = sizes.where((F.col("ids") >= k) & (F.col("total") > 0 if skip_empty else F.lit(True))).select(*inner)
    best_a = top_per_group(df.select(*inner, ident, actual), inner, [(actual, False), (ident, True)], k).select(*inner, ident)
    best_p = top_per_group(df.select(*inner, ident, predicted), inner, [(predicted, False), (ident, True)], k).select(*inner, ident)
    hits = best_a.join(best_p, [*inner, ident]).groupBy(*inner).agg(F.count("*").alias("hits"))
    scored = use.join(hits, inner, "left").withColumn("share", F.coalesce("hits", F.lit(0)) / F.lit(float(k)))
    return scored.groupBy(*outer).agg(
        F.coalesce(F.avg("share"), dbl(0.0)).alias("precision"), F.count("*").alias("groups"))


def prediction_cap(training: DataFrame, validation: DataFrame, actual: str, predicted: str,
                   levels: Sequence[float] = (0.99, 0.995, 0.999, 0.9995, 0.9999, 1.0)) -> DataFrame:
    """RMSE on the validation rows under each training percentile used as a cap; the best is marked."""
    from kerbflow.operators.selection import quantiles

    caps = quantiles(training.select(F.col(actual).cast("double").alias("value")), "value", levels)
    wanted = caps.agg(F.sort_array(F.collect_set("quantile"))).scalar()  # one value per level
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    tried = validation.select(a.alias("a"), p.alias("p"), F.explode(wanted).alias("cap"))
    miss = F.greatest(dbl(0.0), F.least(F.col("p"), F.col("cap"))) - F.col("a")
    rated = tried.groupBy("cap").agg(half_up(F.sqrt(F.avg(miss * miss)), 9).alias("rmse"))
    first = Window.partitionBy(F.lit(0)).orderBy("rmse", "cap")  # one row per candidate cap
    return rated.withColumn("is_best", F.when(F.row_number().over(first) == 1, 1).otherwise(0))


def blend_sweep(df: DataFrame, group: Sequence[str], ident: str, actual: str, first: str, second: str,
                k: int = 10, steps: int = 20) -> DataFrame:
    """Precision at k for blend weights 0, 0.05, ..., 1 of two predictions; the smallest best weight is marked."""
    weight = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / F.lit(float(steps))))
    mixed = df.select(*group, ident, actual, first, second, weight.alias("weight"))
    value = F.col("weight") * F.col(first) + (dbl(1.0) - F.col("weight")) * F.col(second)
    mixed = mixed.withColumn("mixed", half_up(F.greatest(value, dbl(0.0)), 9)).drop(first, second)
    rated = precision_at_k(mixed, group, ident, actual, "mixed", k, ["weight"])
    rated = rated.withColumn("precision", half_up(F.col("precision"), 9))  # the last bits of a mean must not pick the best
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("precision").desc(), "weight")  # one row per weight
    return rated.select("weight", "precision", F.when(F.row_number().over(order) == 1, 1).otherwise(0).alias("is_best"))
