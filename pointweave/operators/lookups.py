"""Lookups on a drawing: the nearest place on its contours, where contours cut it, and what is left of a shape without it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut_lineage
from .clipping import chosen, outlines, windings
from .descent import nearest_sides
from .grids import around, cell
from .planar_map import PlanarMap, crossings, segments

#: Cuts nearer to each other than that are one.
MERGE = 0.5


def nearest(places: DataFrame, rings: DataFrame, ring: str = "ring_id", key: str = "dataset_id") -> DataFrame:
    """For each place (place_id, x, y) the nearest place on any contour (key, ring_id, ring): place_id, key, ring_id, d, nx, ny."""
    sides = segments(rings, key, ring).select(F.struct(key, "ring_id", "k").alias("side_id"), "ix", "iy", "jx", "jy")
    return nearest_sides(places, sides).select("place_id", F.col(f"side_id.{key}").alias(key), F.col("side_id.ring_id").alias("ring_id"), "d", "nx", "ny")


def distances(places: DataFrame, rings: DataFrame, within: float, ring: str = "ring_id", key: str = "dataset_id") -> DataFrame:
    """(place_id, key, ring_id, d) of all contours at most `within` away; contours are dealt to the cells along their sides."""
    from ..functions.planar import segment_distance
    from .grids import cells_along

    side = max(within, 1e-9)
    dealt = cells_along(segments(rings, key, ring), within, side)
    at = places.select("place_id", "x", "y", cell(F.col("x"), side).alias("__cx"), cell(F.col("y"), side).alias("__cy"))
    d = segment_distance(F.col("x"), F.col("y"), F.col("ix"), F.col("iy"), F.col("jx"), F.col("jy"))
    return at.join(dealt, ["__cx", "__cy"]).withColumn("d", d).where(F.col("d") <= within).groupBy("place_id", key, "ring_id").agg(F.min("d").alias("d"))


def intersections(asked: DataFrame, rings: DataFrame, merge: float = MERGE, ring: str = "ring_id", key: str = "dataset_id") -> DataFrame:
    """(key, asked_id, ring_id, t, x, y): where contours to be tested meet those of the drawing of the same key.

    t: side number and fraction along the asked contour. Of places nearer than `merge` to one before them, in order of
    asked contour and t, that stays, only the first stays (merge <= 0: all stay).
    """
    part = lambda d, n: segments(d, key, ring).select(key, F.struct(F.lit(n).alias("part"), F.col("ring_id").alias("id")).alias("ring_id"), "k", "ix", "iy", "jx", "jy")
    both = cut_lineage(part(asked, 0).unionByName(part(rings, 1)))
    met = crossings(both, key, part=F.col("ring_id.part"))
    found = met.select(key, F.col("ring1.id").alias("asked_id"), F.col("ring2.id").alias("ring_id"), (F.col("k1") + F.col("t1")).alias("t"), "x", "y").distinct()
    return first_of_near(found, merge, [key], ["asked_id", "t", "ring_id", "x", "y"]) if merge > 0 else found


def first_of_near(rows: DataFrame, radius: float, keys: list[str], order: list[str]) -> DataFrame:
    """rows (x, y, ...) less those nearer than `radius` to an earlier one that stays.

    In rounds: a row without an undecided earlier neighbour stays if none of them stays, and goes else. Rows meet their
    neighbours by cell, once; a round is two joins of what is undecided, and there are as many as the longest chain of
    neighbours in order has, which is short as neighbours are near.
    """
    rows = cut_lineage(rows)
    me = lambda n: F.struct(*keys, *order).alias(n)
    a = rows.select(*keys, me("late"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell(F.col("x"), radius).alias("cx"), cell(F.col("y"), radius).alias("cy"))
    b = rows.select(*keys, me("early"), F.col("x").alias("bx"), F.col("y").alias("by"), around(F.col("x"), radius).alias("cx")).withColumn("cy", around(F.col("by"), radius))
    near = a.join(b, [*keys, "cx", "cy"]).where("early < late and (ax - bx) * (ax - bx) + (ay - by) * (ay - by) < " + repr(radius * radius)).select("late", "early")
    near = cut_lineage(near)
    left = cut_lineage(rows.select(me("late")))
    stays = None
    while not left.isEmpty():
        waits = near.join(left.select(F.col("late").alias("early")), "early", "left_semi").select("late").distinct()
        ready = left.join(waits, "late", "left_anti")
        if stays is not None:
            ready = ready.join(near.join(stays.select(F.col("late").alias("early")), "early", "left_semi").select("late").distinct(), "late", "left_anti")
        now = cut_lineage(ready)
        stays = now if stays is None else cut_lineage(stays.unionByName(now))
        # Those that wait for no one are decided now: they stay or go.
        left = cut_lineage(left.join(waits, "late", "left_semi"))
    return rows if stays is None else rows.join(stays.select(F.col("late").alias("__me")), F.struct(*keys, *order) == F.col("__me"), "left_semi")


def difference(shapes: DataFrame, rings: DataFrame, ring: str = "ring_id", key: str = "dataset_id") -> DataFrame:
    """(key, loop, ring): what is left of the shapes of each key without the drawing's, holes clockwise."""
    tag = lambda d, clip: d.select(key, F.struct(F.lit(clip).alias("clip"), F.col(ring).alias("id")).alias("ring_id"), "ring", F.lit(clip).alias("clip"))
    m = PlanarMap(tag(shapes, False).unionByName(tag(rings, True)), key)
    return outlines(m, chosen(windings(m, F.col("clip")), "difference", "non_zero").select("face"))
