"""Potential fields of categories on a grid, and where their sign changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INFLUENCE, VERTEX, STEP = 60.0, 30.0, 2.5


def constants(influence: float = INFLUENCE, vertex: float = VERTEX) -> tuple[float, float]:
    """(m, t): influence ends at distance `influence`; one point alone has potential 0 at distance `vertex`."""
    if influence < vertex:
        influence = 1.01 * vertex
    return 1 / influence**2, 1 / vertex**2 - 1 / influence**2


def influence_grid(points: DataFrame, step: float, influence: float = INFLUENCE, vertex: float = VERTEX) -> DataFrame:
    """(type, ix, iy, influence) of the grid nodes within reach of a point of the type.

    A point meets only the nodes in the box that its influence reaches, so rows grow with the points, not with
    points times nodes. At a point itself the influence is infinite.
    """
    m, _ = constants(influence, vertex)
    reach = m**-0.5
    lo, hi = lambda c: F.ceil((F.col(c) - reach) / step).cast("long"), lambda c: F.floor((F.col(c) + reach) / step).cast("long")
    near = points.withColumn("ix", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("iy", F.explode(F.sequence(lo("y"), hi("y"))))
    dx, dy = F.col("ix") * step - F.col("x"), F.col("iy") * step - F.col("y")
    near = near.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") < 1 / m)
    value = F.coalesce(F.try_divide(F.lit(1.0), F.col("d2")), F.lit(float("inf"))) - m
    return near.groupBy("type", "ix", "iy").agg(F.sum(value).alias("influence"))


def potential_grid(points: DataFrame, step: float, influence: float = INFLUENCE, vertex: float = VERTEX) -> DataFrame:
    """(type, ix, iy, potential) where a type has influence: its own minus the others' minus t.

    At a point itself its type's potential is infinite; where points of several types lie, infinite influences cancel.
    """
    _, t = constants(influence, vertex)
    g = influence_grid(points, step, influence, vertex)
    node = Window.partitionBy("ix", "iy")
    endless = F.col("influence") == float("inf")
    g = g.withColumn("total", F.sum("influence").over(node)).withColumn("points", F.sum(endless.cast("int")).over(node))
    own = 2 * F.col("influence") - F.col("total") - t
    return g.select("type", "ix", "iy", F.when(endless, F.when(F.col("points") == 1, float("inf")).otherwise(-t)).otherwise(own).alias("potential"))


def sign_cells(potential: DataFrame) -> DataFrame:
    """Grid cells in which a type's potential changes sign: type, ix, iy, mask (bits: this node, right, above, both)."""
    corner = F.explode(F.array(*[F.struct((F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.lit(bit).alias("bit")) for dx, dy, bit in ((0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8))]))
    up = potential.where("potential > 0").select("type", corner.alias("c")).select("type", "c.ix", "c.iy", "c.bit")
    return up.groupBy("type", "ix", "iy").agg(F.sum("bit").cast("long").alias("mask")).where("mask < 15")
