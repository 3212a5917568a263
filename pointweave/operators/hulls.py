"""Convex hulls of groups of points, their measures, and what they contain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planar import EPS, cross, distance, ring_area, ring_length
from .grids import within_boxes


def hull_of(points: list[tuple]) -> list[tuple]:
    """Clockwise hull of (x, y, ...) tuples from the least point on; collinear points are left out."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list[tuple] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) >= -EPS:
                out.pop()
            out.append(p)
        return out

    return chain(pts)[:-1] + chain(pts[::-1])[:-1]


def hulls(points: DataFrame, by: str = "type") -> DataFrame:
    """(by, ring, ids) for each group.

    Hulls of the batches of a task come first, then the hull of those hulls: only few points of a group are shuffled,
    and no task holds a whole group.
    """
    kind = points.schema[by].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *p) for k, g in pdf.groupby(by) for p in hull_of(list(g[["x", "y", "point_id"]].itertuples(index=False, name=None)))]
            yield pd.DataFrame(rows, columns=[by, "x", "y", "point_id"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull_of(list(pdf[["x", "y", "point_id"]].itertuples(index=False, name=None)))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "ring": [[{"x": x, "y": y} for x, y, _ in ring]], "ids": [[i for _, _, i in ring]]})

    some = points.select(by, "x", "y", "point_id").mapInPandas(partial, f"{by} {kind}, x double, y double, point_id long")
    return some.groupBy(by).applyInPandas(final, f"{by} {kind}, ring array<struct<x:double,y:double>>, ids array<long>")


def hull_edges(hull: DataFrame, by: str = "type") -> DataFrame:
    """(by, p, q): the hull's directed edges, clockwise."""
    following = F.concat(F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))), F.slice("ids", 1, 1))
    return hull.where(F.size("ids") > 1).select(by, F.inline(F.arrays_zip(F.col("ids").alias("p"), following.alias("q"))))


def hull_measures(hull: DataFrame, by: str = "type") -> DataFrame:
    return hull.select(by, F.size("ring").cast("long").alias("n_corners"), F.abs(ring_area(F.col("ring"))).alias("area"), ring_length(F.col("ring")).alias("perimeter"))


def points_in_hulls(points: DataFrame, hull: DataFrame, by: str = "type") -> DataFrame:
    """(point_id, hull): points within or on each hull. Points meet the hulls whose boxes hold them, by cell."""
    following = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    h = hull.where(F.size("ring") > 2).select(F.col(by).alias("hull"), "ring", F.arrays_zip(F.col("ring").alias("p"), following.alias("q")).alias("sides"))
    inside = F.forall("sides", lambda e: cross(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"], F.col("x"), F.col("y")) <= EPS)
    return within_boxes(points.select("point_id", "x", "y"), h).where(inside).select("point_id", "hull")


def spread(points: DataFrame, by: str) -> DataFrame:
    """Box of each group: a cheaper stand-in for its hull."""
    return points.groupBy(by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))


def diameter(hull: DataFrame, by: str = "type") -> DataFrame:
    """The greatest distance of two corners."""
    far = F.array_max(F.flatten(F.transform("ring", lambda p: F.transform("ring", lambda q: distance(p["x"], p["y"], q["x"], q["y"])))))
    return hull.select(by, far.alias("diameter"))
