"""Zero contours of a category's potential, by marching squares, and their members.

Each cell in which the sign changes links the grid edges that the contour crosses there, the positive side to the left. Each
crossed edge lies in two cells and is left in one and entered in the other, so the links are a permutation, whose cycles
are the contours (see cycles): no type and no contour is walked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planar import ring_area, ring_contains
from ..plans.storage import cut_lineage
from .cycles import cycles, ordered
from .fields import INFLUENCE, STEP, VERTEX, constants, potential_grid, sign_cells
from .grids import within_boxes

#: A cell's corners counter-clockwise as bits of its mask, and the grid edge from each corner to the next: the node at its
#: lower left end relative to the cell's, and whether it is upright.
CORNERS = (1, 2, 8, 4)
EDGES = ((0, 0, 0), (1, 0, 1), (0, 1, 0), (0, 0, 1))


def _links(mask: int) -> list[tuple[int, int]]:
    """(from, to) as numbers in EDGES of what a contour crosses in a cell: from where it gets negative, going around
    counter-clockwise, to where it got positive.
    """
    up = [bool(mask & bit) for bit in CORNERS]
    cuts = [(k, up[k]) for k in range(4) if up[k] != up[(k + 1) % 4]]
    return [(k, cuts[n - 1][0]) for n, (k, from_up) in enumerate(cuts) if from_up]


def cell_links(cells: DataFrame) -> DataFrame:
    """(type, node, next) of sign cells: grid edges (type, ix, iy, up), each with the next one along its contour."""
    pairs = lambda m: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _links(m)]).cast("array<struct<a:int,b:int>>")
    of_mask = F.array(*[pairs(m) for m in range(16)])
    edges = F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y"), F.lit(up).alias("up")) for dx, dy, up in EDGES])
    each = cells.select("type", "ix", "iy", F.explode(F.get(of_mask, F.col("mask").cast("int"))).alias("l"))

    def edge(c: str) -> Column:
        e = F.get(edges, F.col(f"l.{c}"))
        return F.struct("type", (F.col("ix") + e["x"]).alias("ix"), (F.col("iy") + e["y"]).alias("iy"), e["up"].alias("up"))

    return each.select("type", edge("a").alias("node"), edge("b").alias("next"))


def zero_contours(points: DataFrame, step: float = STEP, influence: float = INFLUENCE, vertex: float = VERTEX, most_area: float | None = None) -> DataFrame:
    """(type, contour_id, ring, area): rings around positive regions, counter-clockwise, and around holes in them, clockwise.

    contour_id is the ring's least grid edge (ix, iy and 0 for one to the right, 1 for one upwards). Contours of at least
    `most_area` are dropped. Corners lie where the potential is 0 between the nodes of an edge; a node that no influence
    reaches has the potential of an empty plane, and an infinite one counts as 1e12.
    """
    _, t = constants(influence, vertex)
    grid = cut_lineage(potential_grid(points, step, influence, vertex))
    walk = cycles(cell_links(sign_cells(grid)))
    at = walk.select(F.col("node.type").alias("type"), F.col("node.ix").alias("ix"), F.col("node.iy").alias("iy"), F.col("node.up").alias("up"), "cycle", "place")
    ends = [grid.select("type", F.col("ix").alias(f"x{n}"), F.col("iy").alias(f"y{n}"), F.col("potential").alias(f"v{n}")) for n in (1, 2)]
    at = at.withColumn("x1", F.col("ix")).withColumn("y1", F.col("iy")).withColumn("x2", F.col("ix") + 1 - F.col("up")).withColumn("y2", F.col("iy") + F.col("up"))
    for n, e in zip((1, 2), ends, strict=True):
        at = at.join(e, ["type", f"x{n}", f"y{n}"], "left")
    value = lambda n: F.least(F.coalesce(F.col(f"v{n}"), F.lit(-t)), F.lit(1e12))
    share = F.coalesce(F.try_divide(value(1), value(1) - value(2)), F.lit(0.5))
    corner = F.struct(((F.col("x1") + share * (F.col("x2") - F.col("x1"))) * step).alias("x"), ((F.col("y1") + share * (F.col("y2") - F.col("y1"))) * step).alias("y"))
    rings = ordered(at.select("type", F.concat_ws(",", "cycle.ix", "cycle.iy", "cycle.up").alias("contour_id"), "place", corner.alias("p")), ["type", "contour_id"], "place", F.col("p"))
    found = cut_lineage(rings).withColumn("area", F.abs(ring_area(F.col("ring"))))
    return found if most_area is None else found.where(F.col("area") < most_area)


def contour_members(points: DataFrame, contours: DataFrame) -> DataFrame:
    """(type, contour_id, point_id): points of the type within a contour, looked up by the cells of the contours' boxes."""
    c = contours.select("type", "contour_id", "ring")
    return within_boxes(points.select("type", "point_id", "x", "y"), c, ("type",)).where(ring_contains(F.col("ring"), F.col("x"), F.col("y"))).select("type", "contour_id", "point_id")
