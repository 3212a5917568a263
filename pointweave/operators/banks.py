"""Banks (polylines of one category): cover radius, turning, bends, validity. Window functions over each polyline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planar import angle_between, cross, distance, opposite, orientation

BANK = ("dataset_id", "type")


def _order(keys=BANK):
    return Window.partitionBy(*keys).orderBy("point_id")


def hops(points: DataFrame, keys=BANK) -> DataFrame:
    """Each point with the next one's position and the distance to it (null at the end)."""
    w = _order(keys)
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    return points.withColumn("nx", nx).withColumn("ny", ny).withColumn("hop", distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")))


def cover_radius(points: DataFrame, keys=BANK) -> DataFrame:
    """Half of the longest hop; 0 for a single point."""
    return hops(points, keys).groupBy(*keys).agg((F.coalesce(F.max("hop"), F.lit(0.0)) / 2).alias("cover_radius"), F.count(F.lit(1)).alias("n_points"))


def turns(points: DataFrame, keys=BANK) -> DataFrame:
    """For every three points in a row: index (from 0), orientation and turning angle in radians."""
    w = _order(keys)
    t = points.select(*keys, "point_id", "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.lead("x", 2).over(w).alias("x2"), F.lead("y", 2).over(w).alias("y2"), (F.row_number().over(w) - 1).cast("long").alias("k")).where("x2 is not null")
    c = [F.col(n) for n in ("x", "y", "x1", "y1", "x2", "y2")]
    angle = angle_between(c[2] - c[0], c[3] - c[1], c[4] - c[2], c[5] - c[3])
    return t.withColumn("orientation", orientation(cross(*c))).withColumn("angle", F.coalesce(angle, F.lit(0.0))).select(*keys, "point_id", "k", "orientation", "angle")


def bends(points: DataFrame, keys=BANK) -> DataFrame:
    """Runs of turns; a new one begins where a turn is the opposite of the one before (straight is its own opposite)."""
    w = Window.partitionBy(*keys).orderBy("k")
    t = turns(points, keys).withColumn("before", F.lag("orientation").over(w))
    t = t.withColumn("bend", F.sum(F.when(F.col("before") == opposite(F.col("orientation")), 1).otherwise(0)).over(w))
    return t.groupBy(*keys, "bend").agg(
        F.min_by("orientation", "k").alias("orientation"), F.max("angle").alias("max_angle"), F.sum("angle").alias("total_angle"), F.min("k").alias("start_index"), F.count(F.lit(1)).alias("n_turns")
    )


def valid(points: DataFrame, inflection: bool = True, max_turning: float = 70.0, max_bend: float = 180.0, keys=BANK) -> DataFrame:
    """Whether a bank has at most one bend (two with inflection), and keeps the turning and bending limits (degrees)."""
    import math

    per = bends(points, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bends"), F.max("max_angle").alias("max_angle"), F.sum("total_angle").alias("total_angle"))
    every = points.select(*keys).distinct().join(per, list(keys), "left")
    ok = (F.coalesce("n_bends", F.lit(0)) <= (2 if inflection else 1)) & (F.coalesce("max_angle", F.lit(0.0)) <= math.radians(max_turning)) & (F.coalesce("total_angle", F.lit(0.0)) <= math.radians(max_bend))
    return every.select(*keys, F.coalesce("n_bends", F.lit(0)).cast("long").alias("n_bends"), ok.alias("is_valid"))


def part_between(points: DataFrame, start: float, end: float, keys=BANK) -> DataFrame:
    """(keys, length, x0, y0, x1, y1): the part of each bank between two shares of its length, by running lengths."""
    w = _order(keys)
    h = hops(points, keys).where("hop > 0")
    along = h.withColumn("at", F.sum("hop").over(w) - F.col("hop")).withColumn("total", F.sum("hop").over(Window.partitionBy(*keys)))

    def place(axis: str, share: float):
        t = F.greatest(F.lit(0.0), F.lit(share) * F.col("total") - F.col("at")) / F.col("hop")
        here = (F.col("at") <= F.lit(share) * F.col("total")) & ((F.lit(share) * F.col("total") < F.col("at") + F.col("hop")) | F.lit(share >= 1))
        return F.max_by(F.col(axis) + (F.col(f"n{axis}") - F.col(axis)) * t, F.when(here, F.col("at")))

    return along.groupBy(*keys).agg((F.first("total") * (end - start)).alias("length"), place("x", start).alias("x0"), place("y", start).alias("y0"), place("x", end).alias("x1"), place("y", end).alias("y1"))
