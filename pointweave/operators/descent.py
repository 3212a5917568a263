"""Nearest things by descending two grids at once, from one cell that holds all to fine ones.

A pair of cells, one with things that ask and one with things that may answer, has a least and a greatest distance. Pairs
whose least distance is more than the smallest greatest one of the same asker are dropped; what is left is split into
finer cells, on both sides. So dense clusters far from each other meet only where they face each other, and joins have
equal keys: a cell's parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planar import distance, segment_distance
from ..plans.storage import cut_lineage
from .grids import Levels, cell, cells_along, levels_of


class Frame:
    """Cells counted from a box's corner: level 0 has the finest, the last level has one cell that holds the box."""

    def __init__(self, points: DataFrame, levels: Levels | None = None):
        b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        self.x, self.y = b[0] or 0.0, b[2] or 0.0
        self.side = (levels or levels_of(points, ())).side
        width = max((b[1] or 0) - self.x, (b[3] or 0) - self.y)
        self.last = 0
        while self.side * 2.0**self.last <= width:
            self.last += 1

    def at(self, x: Column, y: Column) -> tuple[Column, Column]:
        return cell(x - self.x, self.side), cell(y - self.y, self.side)


def _up(levels: int, c: str) -> Column:
    return F.shiftright(F.col(c), levels)


def _bounds(side: float) -> tuple[Column, Column]:
    """The least and the greatest distance of places in cells (ax, ay) and (bx, by)."""
    gap = lambda p, q, by: F.abs(F.col(p) - F.col(q)) + by
    far = lambda by: F.sqrt(F.pow(F.greatest(gap("ax", "bx", by), F.lit(0)), F.lit(2)) + F.pow(F.greatest(gap("ay", "by", by), F.lit(0)), F.lit(2))) * side
    return far(-1) * (1 - 1e-9), far(1) * (1 + 1e-9)


def _descend(asks: DataFrame, answers: DataFrame, frame: Frame, who: list[str], kinds: list[str], tells: dict[str, object], fits: Column, keep_best) -> DataFrame:
    """Pairs of finest cells (who, ax, ay, kinds, tells, bx, by) that may hold an asker's nearest answer.

    asks: (who, ax, ay); answers: (kinds, tells, bx, by), both on level 0. Cells are told apart by who and kinds; tells
    are aggregates of what a cell holds (name: function). fits: may an answer's cell answer? keep_best(pairs): pairs with
    lo and up, less the hopeless ones.
    """

    def on(level: int) -> tuple[DataFrame, DataFrame]:
        a = asks.select(*who, _up(level, "ax").alias("ax"), _up(level, "ay").alias("ay")).distinct()
        b = answers.select(*kinds, *tells, _up(level, "bx").alias("bx"), _up(level, "by").alias("by")).groupBy(*kinds, "bx", "by").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(c) for c, f in tells.items()])
        return a, b.drop("n")

    a, b = on(frame.last)
    pairs = a.join(b, (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))).where(fits)
    for level in range(frame.last - 1, -1, -1):
        a, b = on(level)
        fine_a = a.select(*who, F.col("ax").alias("cx"), F.col("ay").alias("cy"), _up(1, "ax").alias("ax"), _up(1, "ay").alias("ay"))
        fine_b = b.select(*kinds, *tells, F.col("bx").alias("dx"), F.col("by").alias("dy"), _up(1, "bx").alias("bx"), _up(1, "by").alias("by"))
        met = pairs.drop(*tells).join(fine_a, [*who, "ax", "ay"]).join(fine_b, [*kinds, "bx", "by"])
        met = met.select(*who, *kinds, *tells, F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("dx").alias("bx"), F.col("dy").alias("by")).where(fits)
        lo, up = _bounds(frame.side * 2.0**level)
        pairs = keep_best(met.withColumn("lo", lo).withColumn("up", up)).drop("lo", "up")
        if level % 3 == 0:
            pairs = cut_lineage(pairs)
    return pairs


def nearest_of_other_class(points: DataFrame) -> DataFrame:
    """For each point (point_id, type, x, y) the nearest of another type: point_id, other_id, d; ties to the smaller id."""
    points = cut_lineage(points.select("point_id", "type", "x", "y"))
    frame = Frame(points)
    cx, cy = frame.at(F.col("x"), F.col("y"))
    at = points.withColumn("ax", cx).withColumn("ay", cy)
    # A cell's types matter only as far as whether it has another than the asker's: its least and its greatest tell.
    answers = at.groupBy(F.col("ax").alias("bx"), F.col("ay").alias("by")).agg(F.min("type").alias("low"), F.max("type").alias("high"))
    best = lambda p: p.withColumn("best", F.min("up").over(Window.partitionBy("type", "ax", "ay"))).where("lo <= best").drop("best")
    pairs = _descend(at.select("type", "ax", "ay").distinct(), answers, frame, ["type"], [], {"low": F.min, "high": F.max}, (F.col("low") != F.col("type")) | (F.col("high") != F.col("type")), best)
    there = at.select(F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("type").alias("t2"), F.col("point_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    met = pairs.drop("low", "high").join(at, ["type", "ax", "ay"]).join(there, ["bx", "by"]).where("t2 != type")
    one = met.withColumn("d", distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))).groupBy("point_id").agg(F.min(F.struct("d", "other_id")).alias("b"))
    return one.select("point_id", F.col("b.other_id").alias("other_id"), F.col("b.d").alias("d"))


def least_distances(points: DataFrame) -> DataFrame:
    """(type1, type2, d) with type1 < type2: the least distance of points of two types."""
    points = cut_lineage(points.select("type", "x", "y").distinct())
    frame = Frame(points)
    cx, cy = frame.at(F.col("x"), F.col("y"))
    at = points.select(F.col("type").alias("type1"), "x", "y", cx.alias("ax"), cy.alias("ay"))
    answers = at.select(F.col("type1").alias("type2"), F.col("ax").alias("bx"), F.col("ay").alias("by")).distinct()

    def best(p: DataFrame) -> DataFrame:
        least = p.groupBy(F.col("type1").alias("t1"), F.col("type2").alias("t2")).agg(F.min("up").alias("best"))
        return p.join(least, (F.col("type1") == F.col("t1")) & (F.col("type2") == F.col("t2"))).where("lo <= best").drop("t1", "t2", "best")

    pairs = _descend(at.select("type1", "ax", "ay").distinct(), answers, frame, ["type1"], ["type2"], {}, F.col("type1") < F.col("type2"), best)
    there = at.select(F.col("type1").alias("type2"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    met = pairs.join(at, ["type1", "ax", "ay"]).join(there, ["type2", "bx", "by"])
    return met.groupBy("type1", "type2").agg(F.min(distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))).alias("d"))


def nearest_sides(places: DataFrame, sides: DataFrame) -> DataFrame:
    """For each place (place_id, x, y) the nearest side (side_id, ix, iy, jx, jy): place_id, side_id, d, nx, ny, the nearest
    place on it; ties to the smaller id. Sides are dealt to the cells along them, of about their mean length.
    """
    places, sides = cut_lineage(places.select("place_id", "x", "y")), cut_lineage(sides.select("side_id", "ix", "iy", "jx", "jy"))
    every = places.select("x", "y").unionByName(sides.select(F.col("ix").alias("x"), F.col("iy").alias("y"))).unionByName(sides.select(F.col("jx").alias("x"), F.col("jy").alias("y")))
    mean = sides.agg(F.avg(distance(F.col("ix"), F.col("iy"), F.col("jx"), F.col("jy")))).first()[0] or 1.0
    frame = Frame(every, Levels(max(mean, 1e-9), 0))
    cx, cy = frame.at(F.col("x"), F.col("y"))
    at = places.withColumn("ax", cx).withColumn("ay", cy).withColumn("who", F.lit(0))
    moved = sides.select("side_id", *[(F.col(c) - o).alias(c) for c, o in (("ix", frame.x), ("iy", frame.y), ("jx", frame.x), ("jy", frame.y))])
    dealt = cut_lineage(cells_along(moved, 1e-6 * frame.side, frame.side).select("side_id", F.greatest("__cx", F.lit(0)).alias("bx"), F.greatest("__cy", F.lit(0)).alias("by")))
    best = lambda p: p.withColumn("best", F.min("up").over(Window.partitionBy("who", "ax", "ay"))).where("lo <= best").drop("best")
    pairs = _descend(at.select("who", "ax", "ay").distinct(), dealt.select(F.lit(0).alias("kind"), "bx", "by").distinct(), frame, ["who"], ["kind"], {}, F.lit(True), best)
    met = pairs.join(at, ["who", "ax", "ay"]).join(dealt, ["bx", "by"]).select("place_id", "x", "y", "side_id").distinct().join(sides, "side_id")
    d = segment_distance(F.col("x"), F.col("y"), F.col("ix"), F.col("iy"), F.col("jx"), F.col("jy"))
    one = met.withColumn("d", d).groupBy("place_id", "x", "y").agg(F.min(F.struct("d", "side_id", "ix", "iy", "jx", "jy")).alias("b"))
    b = lambda c: F.col(f"b.{c}")
    long2 = (b("jx") - b("ix")) * (b("jx") - b("ix")) + (b("jy") - b("iy")) * (b("jy") - b("iy"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((F.col("x") - b("ix")) * (b("jx") - b("ix")) + (F.col("y") - b("iy")) * (b("jy") - b("iy")), long2), F.lit(0.0))))
    return one.select("place_id", b("side_id").alias("side_id"), b("d").alias("d"), (b("ix") + t * (b("jx") - b("ix"))).alias("nx"), (b("iy") + t * (b("jy") - b("iy"))).alias("ny"))
