"""Beta-skeletons of categories, and forests grown from them."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planar import angle_between, distance, segments_cross
from ..plans.storage import cut_lineage, side_by_side
from .grids import Levels, cell, cells_along, level_of, levels_of

BETA = 0.534


def angle_limit(beta: float = BETA) -> float:
    return math.pi - math.asin(beta) if beta <= 1 else math.asin(1 / beta)


def _probes(points: DataFrame, keys: tuple[str, ...], level: int | Column, levels: Levels) -> DataFrame:
    """(keys, mx, my, r): for each half cell a point from each of the nine half cells around it."""
    half = levels.side_of(level) / 2
    more = ["level"] if isinstance(level, Column) else []
    one = points.groupBy(*more, *keys, cell(F.col("x"), half).alias("hx"), cell(F.col("y"), half).alias("hy")).agg(F.min(F.struct("x", "y", "type")).alias("r"))
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    return one.withColumn("mx", near("hx")).withColumn("my", near("hy")).drop("hx", "hy")


def _without(pairs: DataFrame, others: DataFrame, on: list[str], hit: Column, kept: list[str]) -> DataFrame:
    """The different pairs that meet no `others` for which hit holds."""
    met = pairs.join(others, on, "left").groupBy(*kept).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"))
    return met.where("not hit").drop("hit")


def _sees_all(px: Column, py: Column, qx: Column, qy: Column, far: float, theta: float):
    """Does a point see all points within `far` of p and of q at more than theta from each other?"""

    def sees(r: Column) -> Column:
        dp, dq = distance(r["x"], r["y"], px, py), distance(r["x"], r["y"], qx, qy)
        angle = angle_between(px - r["x"], py - r["y"], qx - r["x"], qy - r["y"])
        return (dp > far) & (dq > far) & (angle - F.asin(F.try_divide(F.lit(far), dp)) - F.asin(F.try_divide(F.lit(far), dq)) > theta + 1e-9)

    return sees


def _cell_pairs(points: DataFrame, theta: float, keys: tuple[str, ...], levels: Levels) -> DataFrame:
    """(keys, type, ax, ay, bx, by): pairs of finest cells that hold points of a type, less those that one point near
    their middle excludes for all points in them. Coarse pairs are excluded first; only what is left is refined.
    """
    by = [*keys, "type"]
    cells = lambda k, c: points.select(*by, cell(F.col("x"), levels.side_of(k)).alias(f"{c}x"), cell(F.col("y"), levels.side_of(k)).alias(f"{c}y")).distinct()
    pairs = cells(levels.top, "a").join(cells(levels.top, "b"), by).where("struct(ax, ay) <= struct(bx, by)")
    for k in range(levels.top, -1, -1):
        s = levels.side_of(k)
        px, py, qx, qy = ((F.col(c) + 0.5) * s for c in ("ax", "ay", "bx", "by"))
        middle = pairs.withColumn("mx", cell((px + qx) / 2, s / 2)).withColumn("my", cell((py + qy) / 2, s / 2))

        # A corner of a cell is so far from its middle; that turns the sight of it by an arc sine at most.
        far = s * math.sqrt(0.5) * (1 + 1e-9)
        pairs = _without(middle, _probes(points, keys, k, levels), [*keys, "mx", "my"], _sees_all(px, py, qx, qy, far, theta)(F.col("r")), [*by, "ax", "ay", "bx", "by"])
        if k:
            parts = lambda c, k=k: cells(k - 1, "f").select(*by, F.shiftright("fx", 1).alias(f"{c}x"), F.shiftright("fy", 1).alias(f"{c}y"), F.col("fx").alias(f"f{c}x"), F.col("fy").alias(f"f{c}y"))
            fine = pairs.join(parts("a"), [*by, "ax", "ay"]).join(parts("b"), [*by, "bx", "by"])
            same = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
            fine = fine.where(~same | F.expr("struct(fax, fay) <= struct(fbx, fby)"))
            pairs = fine.select(*by, F.col("fax").alias("ax"), F.col("fay").alias("ay"), F.col("fbx").alias("bx"), F.col("fby").alias("by"))
    return pairs


def beta_skeleton(points: DataFrame, beta: float = BETA, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs i < j of one type such that every other point sees them at an angle of at most the limit.

    Points equal in x, y and type to an end don't count; coincident points of another type exclude the pair. Pairs of
    cells are excluded from coarse to fine, then pairs of points by points near their middle; for what is left, all
    points in reach are looked up by cell. All joins have equal keys, and rows grow with the points in all but sparse
    plains, where few points stand.
    """
    theta = angle_limit(beta)
    levels = levels_of(points, (*keys, "type"))
    by, s = [*keys, "type"], levels.side
    end = lambda n, c: points.select(*by, cell(F.col("x"), s).alias(f"{c}x"), cell(F.col("y"), s).alias(f"{c}y"), F.col("point_id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    met = _cell_pairs(points, theta, keys, levels).join(end("p", "a"), [*by, "ax", "ay"]).join(end("q", "b"), [*by, "bx", "by"])
    met = met.where("(ax != bx or ay != by) or p < q")
    up = F.col("p") < F.col("q")
    turn = lambda one, two, name: F.when(up, F.col(one)).otherwise(F.col(two)).alias(name)
    pairs = met.select(*by, turn("p", "q", "i"), turn("q", "p", "j"), turn("px", "qx", "ix"), turn("py", "qy", "iy"), turn("qx", "px", "jx"), turn("qy", "py", "jy"))
    pairs = pairs.withColumn("length", distance(F.col("ix"), F.col("iy"), F.col("jx"), F.col("jy")))
    # All points that see a pair at more than the limit are so near to its segment.
    reach = F.col("length") / 2 / math.tan(theta / 2) * (1 + 1e-9)

    def sees(r: Column) -> Column:
        same = lambda e: (r["type"] == F.col("type")) & (r["x"] == F.col(f"{e}x")) & (r["y"] == F.col(f"{e}y"))
        ax, ay, bx, by_ = F.col("ix") - r["x"], F.col("iy") - r["y"], F.col("jx") - r["x"], F.col("jy") - r["y"]
        lengths = F.sqrt((ax * ax + ay * ay) * (bx * bx + by_ * by_))
        # An angle is greater if its cosine is less; at an end itself there is none, and a point there excludes the pair.
        return ((ax * bx + ay * by_ < math.cos(theta) * lengths) | (lengths == 0)) & ~same("i") & ~same("j")

    every = F.explode(F.sequence(F.lit(0), F.lit(levels.top + 3))).alias("level")
    layered = points.select(*keys, "type", "x", "y", every)
    # First the points around the middle, then all in reach.
    half = levels.side_of(F.col("level")) / 2
    pairs = pairs.withColumn("level", level_of(2 * reach / 1.5, levels)).withColumn("mx", cell((F.col("ix") + F.col("jx")) / 2, half)).withColumn("my", cell((F.col("iy") + F.col("jy")) / 2, half))
    kept = [*by, "i", "j", "ix", "iy", "jx", "jy", "length"]
    pairs = _without(pairs, _probes(layered, keys, F.col("level"), levels), ["level", *keys, "mx", "my"], sees(F.col("r")), kept)
    wide = cells_along(pairs.withColumn("level", level_of(reach, levels)), reach, levels.side_of(F.col("level")))
    side = levels.side_of(F.col("level"))
    third = layered.groupBy("level", *keys, cell(F.col("x"), side).alias("__cx"), cell(F.col("y"), side).alias("__cy"), "x", "y", "type").agg(F.lit(1).alias("one")).select("level", *keys, "__cx", "__cy", F.struct("x", "y", "type").alias("r"))
    return _without(wide, third, ["level", *keys, "__cx", "__cy"], sees(F.col("r")), kept)


def crossings(edges: DataFrame) -> DataFrame:
    """Pairs of edges that cross inside both: (i1, j1) < (i2, j2).

    The edges are written once, dealt to the cells that they pass, and meet where they share a cell; a crossing counts
    in the cell in which it lies.
    """
    edges = cut_lineage(edges)
    side = max(float(edges.agg(F.avg(distance(F.col("ix"), F.col("iy"), F.col("jx"), F.col("jy")))).first()[0] or 1.0), 1e-9)
    dealt = cells_along(edges, 1e-6 * side, side)
    part = lambda n: dealt.select("__cx", "__cy", *[F.col(c).alias(f"{c}{n}") for c in ("type", "i", "j", "ix", "iy", "jx", "jy")])
    before = (F.col("i1") < F.col("i2")) | ((F.col("i1") == F.col("i2")) & (F.col("j1") < F.col("j2")))
    c = [F.col(c) for c in ("ix1", "iy1", "jx1", "jy1", "ix2", "iy2", "jx2", "jy2")]
    met = part(1).join(part(2), ["__cx", "__cy"]).where(before & segments_cross(*c))
    den = (c[2] - c[0]) * (c[7] - c[5]) - (c[3] - c[1]) * (c[6] - c[4])
    t = F.try_divide((c[4] - c[0]) * (c[7] - c[5]) - (c[5] - c[1]) * (c[6] - c[4]), den)
    here = (cell(c[0] + t * (c[2] - c[0]), side) == F.col("__cx")) & (cell(c[1] + t * (c[3] - c[1]), side) == F.col("__cy"))
    return met.where(here).select("i1", "j1", "i2", "j2", "type1", "type2")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(point_id, component): the least point that a point is connected with.

    Least labels spread over the edges and jump along themselves; every round's table is checkpointed. Labels of all points
    are merged, not broadcast, as broadcast tables pass through the driver.
    """
    ends = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))
    both = cut_lineage(edges.select(ends.alias("e")).select("e.*"))  # edges are found once
    label = nodes.select("point_id", F.col("point_id").alias("component"))
    while True:  # labels only fall, so this comes to an end
        seen = both.hint("merge").join(label.hint("merge"), F.col("b") == F.col("point_id")).groupBy("a").agg(F.min("component").alias("m"))
        spread = label.hint("merge").join(seen.hint("merge"), F.col("point_id") == F.col("a"), "left").select("point_id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = spread.select(F.col("point_id").alias("p"), F.col("c").alias("further"))
        new = cut_lineage(spread.hint("merge").join(jump.hint("merge"), F.col("c") == F.col("p")).select("point_id", "old", F.least("c", "further").alias("component")))
        if new.where("old != component").isEmpty():
            return new.select("point_id", "component")
        label = new.select("point_id", "component")


def _meetings(edges: list[tuple], most: int = 500_000) -> tuple[list[int], np.ndarray]:
    """For each edge the places of those that it crosses: (their numbers, begins). Edges are swept by their left ends."""
    e = np.array([row[2:6] for row in edges], dtype=float).reshape(-1, 4)
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    order = np.argsort(low[:, 0], kind="stable")
    ahead = np.searchsorted(low[order, 0], high[order, 0], "right") - np.arange(len(e)) - 1
    ends = np.cumsum(ahead)
    ones, twos, lo = [], [], 0
    while lo < len(e):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        n = np.repeat(np.arange(lo, hi), ahead[lo:hi])
        k, m = order[n], order[n + 1 + np.arange(len(n)) - np.repeat(ends[lo:hi] - ahead[lo:hi] - before, ahead[lo:hi])]
        lo = hi
        some = (low[m, 1] <= high[k, 1]) & (high[m, 1] >= low[k, 1])
        k, m = np.minimum(k[some], m[some]), np.maximum(k[some], m[some])
        one, two = e[k].T, e[m].T
        den = (one[2] - one[0]) * (two[3] - two[1]) - (one[3] - one[1]) * (two[2] - two[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((two[0] - one[0]) * (two[3] - two[1]) - (two[1] - one[1]) * (two[2] - two[0])) / den
            u = ((two[0] - one[0]) * (one[3] - one[1]) - (two[1] - one[1]) * (one[2] - one[0])) / den
        hit = (den != 0) & (t > 0.01) & (t < 0.99) & (u > 0.01) & (u < 0.99)
        ones.append(k[hit])
        twos.append(m[hit])
    one, two = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (ones, twos))
    a, b = np.concatenate([one, two]), np.concatenate([two, one])
    by = np.lexsort([b, a])
    return b[by].tolist(), np.searchsorted(a[by], np.arange(len(e) + 1))


def _forest(edges: list[tuple], met: tuple[list[int], np.ndarray] | None = None) -> list[int]:
    """Places of the edges taken: always one with the fewest crossings left, the first of equals.

    A heap has each edge with its count, again whenever that falls. Of two trees that an edge joins the one with fewer edges
    is searched for those that would close a cycle now.
    """
    numbers, begins = met or _meetings(edges)
    meets = lambda k: numbers[begins[k] : begins[k + 1]]
    count, left, taken = np.diff(begins).tolist(), [e[0] != e[1] for e in edges], []
    parent: dict = {}
    own: dict = {}  # of each tree: the edges at its nodes

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for k, e in enumerate(edges):
        for v in e[:2]:
            own.setdefault(v, []).append(k)
    heap: list[tuple[int, int]] = []

    def drop(k: int) -> None:
        left[k] = False
        for m in meets(k):
            if left[m]:
                count[m] -= 1
                heapq.heappush(heap, (count[m], m))

    for k, e in enumerate(edges):
        if not left[k]:
            drop(k)
    heap += [(c, k) for k, c in enumerate(count) if left[k]]
    heapq.heapify(heap)
    while heap:
        c, k = heapq.heappop(heap)
        if not left[k] or c != count[k]:
            continue
        taken.append(k)
        for m in [k, *meets(k)]:
            if left[m]:
                drop(m)
        small, large = sorted((root(edges[k][0]), root(edges[k][1])), key=lambda v: len(own[v]))
        parent[small] = large
        some = own.pop(small)
        for m in some:
            if left[m] and root(edges[m][0]) == root(edges[m][1]):
                drop(m)
        own[large] += [m for m in some if left[m]]
    return taken


def _augmented(edges: list[tuple], taken: list[int], met: tuple[list[int], np.ndarray] | None = None) -> list[int]:
    """Further edges, in order, that cross no accepted edge of another type."""
    numbers, begins = met or _meetings(edges)
    accepted, more = set(taken), []
    for k, e in enumerate(edges):
        if k not in accepted and not any(m in accepted and edges[m][6] != e[6] for m in numbers[begins[k] : begins[k + 1]]):
            accepted.add(k)
            more.append(k)
    return more


def forest(edges: DataFrame, key: str = "dataset_id", augment: bool = False) -> DataFrame:
    """Of each dataset's skeleton, a crossing-free forest; with augment=True also the edges added to it afterwards.

    The choice is sequential within a dataset, so each dataset is one group; datasets run side by side.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"]).reset_index(drop=True)
        rows = list(pdf[["i", "j", "ix", "iy", "jx", "jy", "type"]].itertuples(index=False, name=None))
        met = _meetings(rows)
        taken = _forest(rows, met)
        more = _augmented(rows, taken, met) if augment else []
        out = pdf.loc[taken + more, [key, "type", "i", "j", "length"]]
        return out.assign(step=range(len(out)), augmented=[False] * len(taken) + [True] * len(more))

    return side_by_side(edges, key).groupBy(key).applyInPandas(run, f"{key} long, type int, i long, j long, length double, step long, augmented boolean")
