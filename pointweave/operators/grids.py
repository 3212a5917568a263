"""Square cells of doubling sides: how joins by distance become equi-joins, whatever the density."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells across the points' box at the coarsest level, and the most levels.
ACROSS, LEVELS = 8, 24
#: Places that decide about levels.
SAMPLE = 10_000


@dataclass(frozen=True)
class Levels:
    """Level 0 has the finest cells, of side `side`; each further level's are twice as wide."""

    side: float
    top: int

    def side_of(self, level: Column | int) -> Column | float:
        return self.side * 2.0**level if isinstance(level, int) else F.pow(F.lit(2.0), level) * self.side


def levels_of(points: DataFrame, keys: tuple[str, ...] = ("type",), most: int = 16) -> Levels:
    """Levels for these points: the finest has about `most` different places of equal keys in its fullest cell at most (or
    is the last of LEVELS). Any level gives right results, so a sample decides: the driver gets a box, a count and about
    SAMPLE places.
    """
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    width = max((b[1] or 0) - (b[0] or 0), (b[3] or 0) - (b[2] or 0), 1e-9) * (1 + 1e-9)
    top = width / ACROSS
    some = points.select(*keys, "x", "y")
    if b[4] > SAMPLE:
        some = some.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / b[4]))
    places = {tuple(r) for r in some.collect()}
    times = max(1.0, b[4] / SAMPLE)
    for down in range(LEVELS):
        side = top / 2**down
        if max(Counter((*k, math.floor(x / side), math.floor(y / side)) for *k, x, y in places).values(), default=0) * times <= max(most, times):
            break
    return Levels(top / 2**down, down)


def cell(v: Column, side: Column | float) -> Column:
    return F.floor(v / side).cast("long")


def around(v: Column, side: Column | float, rings: int = 1) -> Column:
    """The cells of a coordinate and of its neighbours."""
    return F.explode(F.sequence(cell(v, side) - rings, cell(v, side) + rings))


def cells_along(pairs: DataFrame, reach: Column | float, side: Column | float) -> DataFrame:
    """pairs (ix, iy, jx, jy) with a row for each cell __cx, __cy within `reach` of the segment (and some beside)."""
    reach, side = (v if isinstance(v, Column) else F.lit(v) for v in (reach, side))
    low_x, high_x = F.least("ix", "jx") - reach, F.greatest("ix", "jx") + reach
    low_y, high_y = F.least("iy", "jy") - reach, F.greatest("iy", "jy") + reach
    wide = pairs.withColumn("__cx", F.explode(F.sequence(cell(low_x, side), cell(high_x, side))))
    # Only the rows of cells that the segment, so widened, passes in this column of cells.
    left, right = F.col("__cx") * side - reach, (F.col("__cx") + 1) * side + reach
    slope = F.try_divide(F.col("jy") - F.col("iy"), F.col("jx") - F.col("ix"))
    y_at = lambda x: F.col("iy") + slope * (F.greatest(F.least("ix", "jx"), F.least(F.greatest("ix", "jx"), x)) - F.col("ix"))
    y1, y2 = y_at(left), y_at(right)
    lo, hi = F.greatest(low_y, F.coalesce(F.least(y1, y2) - reach, low_y)), F.least(high_y, F.coalesce(F.greatest(y1, y2) + reach, high_y))
    return wide.withColumn("__cy", F.explode(F.sequence(cell(lo, side), cell(F.greatest(lo, hi), side))))


def level_of(length: Column, levels: Levels) -> Column:
    """The finest level whose cells are at least as wide as `length` (the coarsest for longer ones, 0 for lengths of 0)."""
    up = F.ceil(F.log2(F.greatest(length, F.lit(1e-300)) / levels.side))
    return F.least(F.greatest(up, F.lit(0)), F.lit(levels.top + 3)).cast("int")


def within_boxes(points: DataFrame, rings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points (x, y) with the rings (ring, ...) of equal keys whose boxes hold them.

    Each ring is dealt to the cells that its box touches, nine at most, of a side that its own box gives; a point is in one
    cell of each side that occurs. So a wide ring brings small ones no points from afar. Rings without corners hold none.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = rings.where(F.size("ring") > 0).select("*", F.array_min(xs).alias("__x0"), F.array_max(xs).alias("__x1"), F.array_min(ys).alias("__y0"), F.array_max(ys).alias("__y1"))
    wide = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"), F.lit(1e-9))
    boxed = boxed.withColumn("__size", F.ceil(F.log2(wide)).cast("int"))
    sizes = [r[0] for r in boxed.select("__size").distinct().orderBy(F.desc("__size")).limit(LEVELS).collect()] or [0]  # smaller ones count as the smallest
    boxed = boxed.withColumn("__size", F.greatest("__size", F.lit(sizes[-1])))
    side = F.pow(F.lit(2.0), F.col("__size") - 1)
    span = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo), side), cell(F.col(hi), side)))
    dealt = boxed.withColumn("__cx", span("__x0", "__x1")).withColumn("__cy", span("__y0", "__y1"))
    at = points.withColumn("__size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("__cx", cell(F.col("x"), side)).withColumn("__cy", cell(F.col("y"), side))
    box = F.col("x").between(F.col("__x0"), F.col("__x1")) & F.col("y").between(F.col("__y0"), F.col("__y1"))
    return at.join(dealt, [*keys, "__size", "__cx", "__cy"]).where(box).drop("__size", "__cx", "__cy", "__x0", "__x1", "__y0", "__y1")


def boxes_meet(one: DataFrame, two: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (ring, ...) and (other, ...) of equal keys whose boxes meet.

    Each ring is dealt to cells of half its own size or more, for its own size and all greater ones that occur; a pair
    meets in cells of the larger one's size, and counts in the cell of the lower left corner that both boxes have.
    """

    def boxed(rows: DataFrame, ring: str, n: str) -> DataFrame:
        xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
        b = rows.where(F.size(ring) > 0).select("*", F.array_min(xs).alias(f"__x0{n}"), F.array_max(xs).alias(f"__x1{n}"), F.array_min(ys).alias(f"__y0{n}"), F.array_max(ys).alias(f"__y1{n}"))
        wide = F.greatest(F.col(f"__x1{n}") - F.col(f"__x0{n}"), F.col(f"__y1{n}") - F.col(f"__y0{n}"), F.lit(1e-9))
        return b.withColumn(f"__size{n}", F.ceil(F.log2(wide)).cast("int"))

    a, b = boxed(one, "ring", "a"), boxed(two, "other", "b")
    sizes = sorted({r[0] for r in a.select("__sizea").distinct().unionByName(b.select(F.col("__sizeb").alias("__sizea")).distinct()).distinct().orderBy(F.desc("__sizea")).limit(LEVELS).collect()}) or [0]

    def dealt(rows: DataFrame, n: str) -> DataFrame:
        own = F.greatest(F.col(f"__size{n}"), F.lit(sizes[0]))
        every = rows.withColumn(f"__size{n}", own).withColumn("__at", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda v: v >= F.col(f"__size{n}"))))
        side = F.pow(F.lit(2.0), F.col("__at") - 1)
        span = lambda axis: F.explode(F.sequence(cell(F.col(f"__{axis}0{n}"), side), cell(F.col(f"__{axis}1{n}"), side)))
        return every.withColumn("__cx", span("x")).withColumn("__cy", span("y"))

    met = dealt(a, "a").join(dealt(b, "b"), [*keys, "__at", "__cx", "__cy"]).where(F.col("__at") == F.greatest("__sizea", "__sizeb"))
    side = F.pow(F.lit(2.0), F.col("__at") - 1)
    here = (cell(F.greatest("__x0a", "__x0b"), side) == F.col("__cx")) & (cell(F.greatest("__y0a", "__y0b"), side) == F.col("__cy"))
    meets = F.expr("__x0a <= __x1b and __x0b <= __x1a and __y0a <= __y1b and __y0b <= __y1a")
    own = [f"__{c}{n}" for n in "ab" for c in ("x0", "x1", "y0", "y1", "size")]
    return met.where(meets & here).drop("__at", "__cx", "__cy", *own)
