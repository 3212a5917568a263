"""Partitions of points into patterns, histories of partitions, and set-shaped operators on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history_cut(history: DataFrame, threshold: float, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """The last row of the prefix whose times are all below the threshold (times aren't monotone).

    The first late row of each key is an aggregate, so no key's rows are sorted.
    """
    late = history.where(F.col("time") >= threshold).groupBy(*keys).agg(F.min("seq").alias("__late"))
    kept = history.join(late, list(keys), "left").where("__late is null or seq < __late")
    return kept.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by("time", "seq").alias("time"))


def merge_patterns(membership: DataFrame, a: int, b: int, new: int) -> DataFrame:
    """(point_id, pattern_id) with two patterns replaced by one."""
    return membership.withColumn("pattern_id", F.when(F.col("pattern_id").isin(a, b), F.lit(new)).otherwise(F.col("pattern_id")))


def break_pattern(membership: DataFrame, point_id: int) -> DataFrame:
    """Remove a point; the others of its pattern become patterns of their own (numbered -1 - point_id)."""
    hit = membership.where(F.col("point_id") == point_id).select(F.col("pattern_id").alias("__hit"))
    joined = membership.where(F.col("point_id") != point_id).join(hit, F.col("pattern_id") == F.col("__hit"), "left")
    return joined.select("point_id", F.when(F.col("__hit").isNotNull(), -1 - F.col("point_id")).otherwise(F.col("pattern_id")).alias("pattern_id"))


def prune_hyperedges(edges: DataFrame) -> DataFrame:
    """(edge_id, origins): drop edges whose origins are all in an edge with exactly one more.

    Each different set of origins gives its subsets with one less; an edge is dropped if it is among them. So rows
    grow with the sets, not with pairs of edges.
    """
    key = F.array_sort(F.array_distinct("origins"))
    sets = edges.select(key.alias("big")).distinct()
    subset = lambda i: F.filter(F.col("big"), lambda _, k: k != i)
    small = sets.select(F.explode(F.transform("big", lambda _, i: subset(i))).alias("small")).distinct()
    return edges.withColumn("__key", key).join(small, F.col("__key") == F.col("small"), "left_anti").select("edge_id", "origins")


def resolve_preference(components: DataFrame) -> DataFrame:
    """Stacking preference of left against right in a component; the first rule that decides wins, else EQ.

    1. left_discs, right_discs: discs around a side's points that the other side has to avoid; the side with fewer: LT
       for left, GT for right.
    2. left_bent, right_bent: whether any part of a side's outline that would be indented is bent. Straight parts are
       indented rather than bent ones: LT if only left has a bent one.
    3. left_straight, right_straight: whether all of a side's outline there is straight. Straight outlines are covered
       rather than bent ones: LT if only left is straight.
    """
    by_discs = F.when(F.col("left_discs") < F.col("right_discs"), "LT").when(F.col("left_discs") > F.col("right_discs"), "GT")
    indented = F.when(F.col("left_bent") & ~F.col("right_bent"), "LT").when(F.col("right_bent") & ~F.col("left_bent"), "GT")
    covered = F.when(F.col("left_straight") & ~F.col("right_straight"), "LT").when(F.col("right_straight") & ~F.col("left_straight"), "GT")
    return components.withColumn("preference", F.coalesce(by_discs, indented, covered, F.lit("EQ")))


def density_distortion(area: DataFrame, points: DataFrame) -> DataFrame:
    """(mean_percent, max_percent): the gaps between each type's share of the area and of the points."""
    n = points.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    shares = n.join(area, "type", "left").select(F.abs(F.coalesce("area", F.lit(0.0)) / F.sum(F.coalesce("area", F.lit(0.0))).over(every) - F.col("n") / F.sum("n").over(every)).alias("gap"))
    return shares.agg((100 * F.avg("gap")).alias("mean_percent"), (100 * F.max("gap")).alias("max_percent"))
