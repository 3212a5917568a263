"""Column functions for points, segments and rings in the plane. All stay in generated JVM code.

A ring is array<struct<x:double,y:double>>, not repeating its first point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def xy(c: Column) -> tuple[Column, Column]:
    return c["x"], c["y"]


def cross(px, py, qx, qy, rx, ry) -> Column:
    """Twice the signed area of p, q, r: positive if r is left of p -> q."""
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def orientation(d: Column) -> Column:
    return F.when(F.abs(d) <= EPS, "STRAIGHT").when(d > 0, "LEFT").otherwise("RIGHT")


def side_of(a: Column, b: Column) -> Column:
    """LEFT if a is less than b, RIGHT if greater, STRAIGHT if they are equal but for EPS."""
    return F.when(F.abs(a - b) <= EPS, "STRAIGHT").when(a < b, "LEFT").otherwise("RIGHT")


def polarity(o: Column) -> Column:
    return F.when(o == "RIGHT", "CCW_POSITIVE_Y").otherwise("CW_NEGATIVE_Y")


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """The vector with length 1; null for one without length."""
    n = F.sqrt(x * x + y * y)
    return F.try_divide(x, n), F.try_divide(y, n)


def bisector(vx: Column, vy: Column, wx: Column, wy: Column) -> tuple[Column, Column]:
    """The direction midway between two vectors."""
    (ax, ay), (bx, by) = unit(vx, vy), unit(wx, wy)
    return unit(ax + bx, ay + by)


def turn_from(x: Column, y: Column, start: Column | float) -> Column:
    """Degrees from the direction `start` on to that of (x, y): more than 0, at most 360, so the start itself is last.

    Ascending it orders vectors around a point in the direction RIGHT, descending in the direction LEFT.
    """
    t = F.degrees(F.atan2(y, x)) - start
    turn = t - 360 * F.floor(t / 360)
    return F.when(turn <= 0, turn + 360).otherwise(turn)


def fit(box: tuple[Column, Column, Column, Column], into: tuple[Column, Column, Column, Column]) -> tuple:
    """The affine map (see affine()) that puts `into` over `box`, centre to centre, scaled by the greater ratio of their
    sides. Boxes are (x0, y0, x1, y1); `into` is taken relative to its corner.
    """
    w, h = into[2] - into[0], into[3] - into[1]
    k = F.greatest(F.try_divide(box[2] - box[0], w), F.try_divide(box[3] - box[1], h))
    zero = F.lit(0.0)
    return k, zero, zero, k, (box[0] + box[2]) / 2 - into[0] - k * w / 2, (box[1] + box[3]) / 2 - into[1] - k * h / 2


def opposite(o: Column) -> Column:
    return F.when(o == "LEFT", "RIGHT").when(o == "RIGHT", "LEFT").otherwise("STRAIGHT")


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of p from the segment a-b; a point for a segment of length 0."""
    long2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.coalesce(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), long2), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def angle_between(vx, vy, wx, wy) -> Column:
    """The angle of two vectors, 0 to pi; null if one has no length. The cosine is kept within -1 to 1."""
    lengths = F.sqrt(vx * vx + vy * vy) * F.sqrt(wx * wx + wy * wy)
    return F.when(lengths > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(vx * wx + vy * wy, lengths)))))


def directed_angle(vx, vy, wx, wy) -> Column:
    """0 to 2 pi."""
    return F.atan2(-(vx * wy - vy * wx), -(vx * wx + vy * wy)) + math.pi


def circumradius(a: Column, b: Column, c: Column) -> Column:
    """Of a triangle with these side lengths; null if it has no area."""
    return F.try_divide(a * b * c, F.sqrt(F.greatest((a + b + c) * (b + c - a) * (c + a - b) * (a + b - c), F.lit(0.0))))


def cover_radius_triangle(a: Column, b: Column, c: Column) -> Column:
    """The least radius of discs at the corners that cover a triangle with these side lengths."""
    s = F.array_sort(F.array(a, b, c))
    low, mid, top = s[0], s[1], s[2]
    acute = top * top <= low * low + mid * mid
    cos_low = F.try_divide(mid * mid + top * top - low * low, 2 * mid * top)
    return F.when(acute, circumradius(a, b, c)).otherwise(F.try_divide(mid, 2 * cos_low))


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def round_half_up(v: Column, decimals: int = 3) -> Column:
    """Ties go towards positive infinity."""
    return F.floor(v * 10**decimals + 0.5) / 10**decimals


def decimal_text(v: Column, decimals: int = 3) -> Column:
    """A number rounded half up, always with that many decimals."""
    k, unit = F.floor(v * 10**decimals + 0.5).cast("long"), 10**decimals
    return F.concat(F.when(k < 0, "-").otherwise(""), F.floor(F.abs(k) / unit).cast("long").cast("string"), F.lit("."), F.lpad((F.abs(k) % unit).cast("string"), decimals, "0"))


def _turns(ring: Column) -> Column:
    """The ring's points, each with the next one."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("p"), following.alias("q"))


def ring_area(ring: Column) -> Column:
    """Signed: positive if counter-clockwise."""
    return F.aggregate(_turns(ring), F.lit(0.0), lambda s, e: s + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]) / 2)


def ring_length(ring: Column) -> Column:
    return F.aggregate(_turns(ring), F.lit(0.0), lambda s, e: s + distance(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: does a ray to the right cross the ring an odd number of times?"""
    hits = F.filter(_turns(ring), lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < e["p"]["x"] + (e["q"]["x"] - e["p"]["x"]) * F.try_divide(y - e["p"]["y"], e["q"]["y"] - e["p"]["y"])))
    return F.size(hits) % 2 == 1


def ring_winding(ring: Column, x: Column, y: Column) -> Column:
    """How often a ring goes around a place, counter-clockwise."""

    def add(s: Column, e: Column) -> Column:
        p, q = e["p"], e["q"]
        left = cross(p["x"], p["y"], q["x"], q["y"], x, y)
        return s + F.when((p["y"] <= y) & (q["y"] > y) & (left > 0), 1).when((p["y"] > y) & (q["y"] <= y) & (left < 0), -1).otherwise(0)

    return F.aggregate(_turns(ring), F.lit(0), add)


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance from the ring's line; points inside are at a positive distance, too."""
    return F.array_min(F.transform(_turns(ring), lambda e: segment_distance(x, y, e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"])))


def ring_holds(ring: Column, x: Column, y: Column) -> Column:
    """ring_contains, but a place on the ring's line, or nearer to it than 1e-9, is on neither side."""
    return ring_contains(ring, x, y) & (ring_distance(ring, x, y) > 1e-9)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy, inner: float = 0.01) -> Column:
    """Do a-b and c-d cross between the fractions `inner` and 1 - `inner` of both?"""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), den)
    u = F.try_divide((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), den)
    return F.coalesce((t > inner) & (t < 1 - inner) & (u > inner) & (u < 1 - inner), F.lit(False))
