"""Contours of line segments and circular arcs as array columns: exact lengths, areas, parts and regions around patterns.

A piece is a struct ax, ay, bx, by (its ends), cx, cy, r, a0, turn: an arc around (cx, cy) of radius r from the angle a0 on,
turning by `turn` radians, counter-clockwise if positive; turn is 0 for a line. A contour is an array of pieces, each of
which begins where the one before ends; a closed one ends where it begins. All stays in generated JVM code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .planar import _turns, decimal_text, distance

FIELDS = ("ax", "ay", "bx", "by", "cx", "cy", "r", "a0", "turn")


def _c(v: Column | float) -> Column:
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def _let(value: Column, f) -> Column:
    """f(value), with the value's expression standing once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _piece(*values: Column | float) -> Column:
    return F.struct(*[_c(v).alias(n) for n, v in zip(FIELDS, values, strict=True)])


def line(ax, ay, bx, by) -> Column:
    return _piece(ax, ay, bx, by, 0.0, 0.0, 0.0, 0.0, 0.0)


def arc(cx, cy, r, a0, turn) -> Column:
    given = F.struct(*[_c(v).alias(n) for n, v in zip(FIELDS[4:], (cx, cy, r, a0, turn), strict=True)])
    x, y = (lambda s, a: s["cx"] + s["r"] * F.cos(a)), (lambda s, a: s["cy"] + s["r"] * F.sin(a))
    end = lambda s: s["a0"] + s["turn"]
    return _let(given, lambda s: _piece(x(s, s["a0"]), y(s, s["a0"]), x(s, end(s)), y(s, end(s)), *[s[n] for n in FIELDS[4:]]))


def circle(cx, cy, r) -> Column:
    """A contour: the whole circle counter-clockwise, from its rightmost place on."""
    return F.array(arc(cx, cy, r, 0.0, 2 * math.pi))


def _positive(angle: Column) -> Column:
    """The same direction between 0 and 2 pi."""
    return _let(angle, lambda a: a - 2 * math.pi * F.floor(a / (2 * math.pi)))


def circle_part(cx, cy, r, px, py, qx, qy, left: Column | bool | None = True) -> Column:
    """The arc of a circle from the direction of p to that of q: counter-clockwise if left, else clockwise; with left=None
    the shorter one (counter-clockwise if they are equal). Equal directions give a whole circle, or, with None, no turn.
    """
    cx, cy = _c(cx), _c(cy)
    a, b = F.atan2(py - cy, px - cx), F.atan2(qy - cy, qx - cx)
    if left is None:
        return arc(cx, cy, r, a, _let(_positive(b - a), lambda t: F.when(t <= math.pi, t).otherwise(t - 2 * math.pi)))
    side = left if isinstance(left, Column) else F.lit(left)
    return arc(cx, cy, r, a, _let(_positive(b - a), lambda t: F.when(side, F.when(t == 0, 2 * math.pi).otherwise(t)).otherwise(F.when(t == 0, -2 * math.pi).otherwise(t - 2 * math.pi))))


def piece_length(p: Column) -> Column:
    return F.when(p["turn"] == 0, distance(p["ax"], p["ay"], p["bx"], p["by"])).otherwise(p["r"] * F.abs(p["turn"]))


def length(contour: Column) -> Column:
    return F.aggregate(contour, F.lit(0.0), lambda s, p: s + piece_length(p))


def area(contour: Column) -> Column:
    """Of what a closed contour encloses, by Green's theorem: positive if counter-clockwise. Exact for arcs."""

    def twice(p: Column) -> Column:
        chord = p["ax"] * p["by"] - p["bx"] * p["ay"]
        return F.when(p["turn"] == 0, chord).otherwise(p["r"] * p["r"] * p["turn"] + p["cx"] * (p["by"] - p["ay"]) - p["cy"] * (p["bx"] - p["ax"]))

    return F.aggregate(contour, F.lit(0.0), lambda s, p: s + twice(p)) / 2


def start(contour: Column) -> tuple[Column, Column]:
    first = F.get(contour, F.lit(0))
    return first["ax"], first["ay"]


def end(contour: Column) -> tuple[Column, Column]:
    last = F.element_at(contour, -1)
    return last["bx"], last["by"]


def piece_part(p: Column, lo: Column, hi: Column) -> Column:
    """The part of a piece between two fractions of its length."""

    def cut(s: Column) -> Column:
        p, lo, hi = s["p"], s["lo"], s["hi"]
        dx, dy = p["bx"] - p["ax"], p["by"] - p["ay"]
        straight = line(p["ax"] + lo * dx, p["ay"] + lo * dy, p["ax"] + hi * dx, p["ay"] + hi * dy)
        return F.when(p["turn"] == 0, straight).otherwise(arc(p["cx"], p["cy"], p["r"], p["a0"] + lo * p["turn"], (hi - lo) * p["turn"]))

    return _let(F.struct(p.alias("p"), lo.alias("lo"), hi.alias("hi")), cut)


def part(contour: Column, t0: Column | float, t1: Column | float) -> Column:
    """The part of a contour between two shares of its length, t0 <= t1; pieces that it only touches are left out."""
    ends = F.aggregate(contour, F.array(F.lit(0.0)), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + piece_length(p))))

    def all_(g: Column) -> Column:
        def cut(p: Column, i: Column) -> Column:
            at = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(t * F.element_at(g["ends"], -1) - F.get(g["ends"], i), F.get(g["ends"], i + 1) - F.get(g["ends"], i)), F.lit(0.0))))
            return F.struct(at(g["t0"]).alias("lo"), at(g["t1"]).alias("hi"), p.alias("p"))

        return F.transform(F.filter(F.transform(g["contour"], cut), lambda s: s["hi"] > s["lo"]), lambda s: piece_part(s["p"], s["lo"], s["hi"]))

    return _let(F.struct(contour.alias("contour"), ends.alias("ends"), _c(t0).alias("t0"), _c(t1).alias("t1")), all_)


def part_around(contour: Column, t0: Column | float, t1: Column | float) -> Column:
    """part() of a closed contour, through its beginning if t1 < t0."""
    t0, t1 = _c(t0), _c(t1)
    return F.when(t0 <= t1, part(contour, t0, t1)).otherwise(F.concat(part(contour, t0, 1.0), part(contour, 0.0, t1)))


def _until(contour: Column, t: Column | float) -> Column:
    """(p, on): the last piece before a share of the length, cut there; at the beginning the first piece, and on is false."""
    return _let(F.struct(contour.alias("c"), _c(t).alias("t")), lambda g: F.when(g["t"] > 0, F.struct(F.element_at(part(g["c"], 0.0, g["t"]), -1).alias("p"), F.lit(True).alias("on"))).otherwise(F.struct(F.get(g["c"], F.lit(0)).alias("p"), F.lit(False).alias("on"))))


def place(contour: Column, t: Column | float) -> tuple[Column, Column]:
    """The place at a share of the length."""
    at = _let(_until(contour, t), lambda p: F.struct(F.when(p["on"], p["p"]["bx"]).otherwise(p["p"]["ax"]).alias("x"), F.when(p["on"], p["p"]["by"]).otherwise(p["p"]["ay"]).alias("y")))
    return at["x"], at["y"]


def direction(contour: Column, t: Column | float) -> tuple[Column, Column]:
    """The unit tangent at a share of the length; at a corner that of the piece before it, at the beginning the first's."""

    def angle(s: Column) -> Column:
        p = s["p"]
        along = F.atan2(p["by"] - p["ay"], p["bx"] - p["ax"])
        around = p["a0"] + F.when(s["on"], p["turn"]).otherwise(0.0) + F.signum(p["turn"]) * (math.pi / 2)
        return F.when(p["turn"] == 0, along).otherwise(around)

    a = _let(_until(contour, t), angle)
    return F.cos(a), F.sin(a)


def extend(contour: Column, by: Column | float) -> Column:
    """With a straight stub of that length, along the tangent, at both ends."""

    def stubs(g: Column) -> Column:
        c, by = g["c"], g["by"]
        (x0, y0), (x1, y1) = start(c), end(c)
        (u0, v0), (u1, v1) = direction(c, 0.0), direction(c, 1.0)
        return F.concat(F.array(line(x0 - by * u0, y0 - by * v0, x0, y0)), c, F.array(line(x1, y1, x1 + by * u1, y1 + by * v1)))

    return _let(F.struct(contour.alias("c"), _c(by).alias("by")), stubs)


def around_ring(ring: Column, r: Column | float) -> Column:
    """The contour at distance r around a convex ring (counter-clockwise), a segment (two points) or a point: an arc at
    each corner, and the sides moved outwards. Its area is that of the ring, plus r times its length, plus pi r squared.
    """
    r = _c(r)
    sides = F.transform(_turns(ring), lambda e: F.struct(e["p"]["x"].alias("px"), e["p"]["y"].alias("py"), e["q"]["x"].alias("qx"), e["q"]["y"].alias("qy"), F.atan2(e["q"]["y"] - e["p"]["y"], e["q"]["x"] - e["p"]["x"]).alias("a")))

    def corners(all_: Column) -> Column:
        def corner(s: Column, i: Column) -> Column:
            before = F.get(all_, F.pmod(i - 1, F.size(all_)))["a"]
            out = s["a"] - math.pi / 2
            dx, dy = r * F.cos(out), r * F.sin(out)
            return F.array(arc(s["px"], s["py"], r, before - math.pi / 2, _positive(s["a"] - before)), line(s["px"] + dx, s["py"] + dy, s["qx"] + dx, s["qy"] + dy))

        return F.flatten(F.transform(all_, corner))

    only = F.get(ring, F.lit(0))
    return F.when(F.size(ring) == 1, circle(only["x"], only["y"], r)).when(F.size(ring) > 1, _let(sides, corners))


def around_line(path: Column, r: Column | float) -> Column:
    """The contour at distance r around a polyline: sides moved to the left and right, arcs at outer turns, half circles at
    both ends. At an inner turn the moved sides end where they meet, or at the hop's end if it is too short for that.
    """
    r = _c(r)
    n = F.size(path)
    hops = F.zip_with(F.slice(path, 1, n - 1), F.slice(path, 2, n - 1), lambda p, q: F.struct(p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy"), F.atan2(q["y"] - p["y"], q["x"] - p["x"]).alias("a"), distance(p["x"], p["y"], q["x"], q["y"]).alias("d")))
    back = F.transform(F.reverse(hops), lambda h: F.struct(h["qx"].alias("px"), h["qy"].alias("py"), h["px"].alias("qx"), h["py"].alias("qy"), (h["a"] + math.pi).alias("a"), h["d"].alias("d")))

    def side(hops: Column) -> Column:
        """The right side of the hops, in their direction, and the half circle around its end."""

        def one(h: Column, i: Column) -> Column:
            last = i == F.size(hops) - 1
            turned = lambda a, b: math.pi - _positive(math.pi - (b - a))  # noqa: E731, between -pi and pi
            after = F.when(last, 0.0).otherwise(turned(h["a"], F.get(hops, i + 1)["a"]))
            before = F.when(i == 0, 0.0).otherwise(turned(F.get(hops, i - 1)["a"], h["a"]))
            trim = lambda t: F.when(t < 0, F.least(h["d"], r * F.tan(-t / 2))).otherwise(0.0)
            ux, uy = F.cos(h["a"]), F.sin(h["a"])
            ox, oy = r * uy, -r * ux  # to the right
            straight = line(h["px"] + ox + trim(before) * ux, h["py"] + oy + trim(before) * uy, h["qx"] + ox - trim(after) * ux, h["qy"] + oy - trim(after) * uy)
            bend = arc(h["qx"], h["qy"], r, h["a"] - math.pi / 2, F.when(last, math.pi).otherwise(after))
            return F.when(last | (after > 0), F.array(straight, bend)).otherwise(F.array(straight))

        return F.flatten(F.transform(hops, one))

    only = F.get(path, F.lit(0))
    return F.when(n == 1, circle(only["x"], only["y"], r)).when(n > 1, F.concat(_let(hops, side), _let(back, side)))


def path_data(contour: Column) -> Column:
    """SVG path data of a closed contour; a whole circle is drawn as two halves."""
    to = lambda x, y: F.concat(decimal_text(x), F.lit(","), decimal_text(y))

    def bend(p: Column, lo: float, hi: float) -> Column:
        own = piece_part(p, F.lit(lo), F.lit(hi))
        large = F.when(F.abs(own["turn"]) > math.pi, "1").otherwise("0")
        return F.concat(F.lit("A"), decimal_text(p["r"]), F.lit(","), decimal_text(p["r"]), F.lit(" 0 "), large, F.lit(","), F.when(p["turn"] > 0, "1").otherwise("0"), F.lit(" "), to(own["bx"], own["by"]))

    step = lambda p: F.when(p["turn"] == 0, F.concat(F.lit("L"), to(p["bx"], p["by"]))).when(F.abs(p["turn"]) > 6, F.concat(bend(p, 0.0, 0.5), F.lit(" "), bend(p, 0.5, 1.0))).otherwise(bend(p, 0.0, 1.0))
    x, y = start(contour)
    return F.concat(F.lit("M"), to(x, y), F.lit(" "), F.array_join(F.transform(contour, step), " "), F.lit(" Z"))
