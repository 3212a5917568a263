"""Contours of lines and arcs against closed forms and sampled ones."""

import math

import pytest
from pyspark.sql import functions as F

from pointweave.functions import arcs
from pointweave.sources.svg import path_ring


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def sampled(contour, n=2000):
    out = []
    for p in contour:
        for k in range(n):
            t = k / n
            if p.turn:
                out.append((p.cx + p.r * math.cos(p.a0 + t * p.turn), p.cy + p.r * math.sin(p.a0 + t * p.turn)))
            else:
                out.append((p.ax + t * (p.bx - p.ax), p.ay + t * (p.by - p.ay)))
    return out


def shoelace(points):
    return sum(points[i - 1][0] * points[i][1] - points[i][0] * points[i - 1][1] for i in range(len(points))) / 2


def closed(contour):
    return all(math.hypot(p.bx - q.ax, p.by - q.ay) < 1e-9 for p, q in zip(contour, contour[1:] + contour[:1], strict=True))


def test_regions_around_patterns(spark):
    shapes = {"point": ([(3, 4)], 0, 0), "segment": ([(0, 0), (3, 4)], 0, 10), "square": ([(0, 0), (4, 0), (4, 4), (0, 4)], 16, 16), "triangle": ([(0, 0), (6, 0), (0, 8)], 24, 24)}
    for points, area, length in shapes.values():
        c = arcs.around_ring(ring(*points), 2.0)
        row = one(spark, c, arcs.area(c), arcs.length(c))
        assert closed(row.c0)
        assert row.c1 == pytest.approx(area + 2 * length + 4 * math.pi)
        assert row.c2 == pytest.approx(length + 4 * math.pi)
        assert shoelace(sampled(row.c0)) == pytest.approx(row.c1, rel=1e-5)


def test_regions_around_lines(spark):
    turn = math.pi / 3
    bent = [(0, 0), (10, 0), (10 + 10 * math.cos(turn), 10 * math.sin(turn)), (20 + 10 * math.cos(turn), 10 * math.sin(turn))]
    for path in (bent, [(x, -y) for x, y in bent], [(0, 0), (5, 0), (9, 0)], [(0, 0), (2, 7)], [(1, 1)]):
        c = arcs.around_line(ring(*path), 1.5)
        row = one(spark, c, arcs.area(c), arcs.length(c))
        assert closed(row.c0)
        hops = sum(math.dist(p, q) for p, q in zip(path, path[1:]))
        turns = 2 if len(path) == 4 else 0
        want = 3 * hops + 2.25 * math.pi + turns * 2.25 * (turn / 2 - math.tan(turn / 2))
        assert row.c1 == pytest.approx(want)
        assert shoelace(sampled(row.c0)) == pytest.approx(want, rel=1e-5)
    # Straight joints have no arc; half circles are at the ends.
    row = one(spark, arcs.around_line(ring((0, 0), (5, 0), (9, 0)), 1.0))
    assert sum(p.turn != 0 for p in row.c0) == 2


def test_parts_of_circles(spark):
    at = (F.lit(1.0), F.lit(2.0), F.lit(5.0), F.lit(6.0), F.lit(2.0), F.lit(1.0), F.lit(7.0))
    row = one(spark, *[arcs.circle_part(*at, left=x) for x in (True, False, None)])
    assert [p.turn for p in row] == pytest.approx([math.pi / 2, -3 * math.pi / 2, math.pi / 2])
    assert all((p.ax, p.ay, p.bx, p.by) == pytest.approx((6, 2, 1, 7)) for p in row)
    whole = one(spark, *[arcs.circle_part(*at[:5], F.lit(9.0), F.lit(2.0), left=x) for x in (True, False, None)])
    assert [p.turn for p in whole] == pytest.approx([2 * math.pi, -2 * math.pi, 0])


def test_parts_places_and_directions(spark):
    c = arcs.around_ring(ring((0, 0), (4, 0), (4, 4), (0, 4)), 2.0)
    total = 16 + 4 * math.pi
    for t0, t1 in ((0.0, 1.0), (0.1, 0.35), (0.2, 0.9)):
        row = one(spark, arcs.part(c, t0, t1), arcs.length(arcs.part(c, t0, t1)), *arcs.place(c, t0), *arcs.place(c, t1), *arcs.start(arcs.part(c, t0, t1)), *arcs.end(arcs.part(c, t0, t1)))
        assert row.c1 == pytest.approx((t1 - t0) * total)
        assert (row.c6, row.c7, row.c8, row.c9) == pytest.approx((row.c2, row.c3, row.c4, row.c5))
        assert closed(row.c0) or (t0, t1) != (0.0, 1.0)
    row = one(spark, arcs.length(arcs.part_around(c, 0.8, 0.3)), *arcs.direction(c, 0.0), *arcs.direction(c, math.pi / total), *arcs.direction(c, (math.pi + 1) / total))
    assert row.c0 == pytest.approx(0.5 * total)
    # From the first corner's arc, which begins on the left side going down, to the lower side, going right.
    assert tuple(row)[1:] == pytest.approx((0, -1, 1, 0, 1, 0), abs=1e-9)
    row = one(spark, arcs.extend(F.array(arcs.arc(0.0, 0.0, 1.0, 0.0, math.pi / 2)), 3.0))
    assert [(p.ax, p.ay, p.bx, p.by) for p in (row.c0[0], row.c0[-1])] == [pytest.approx((1, -3, 1, 0), abs=1e-9), pytest.approx((0, 1, -3, 1), abs=1e-9)]


def test_arcs_in_drawings_are_read_again(spark):
    """A region with arcs and a circle, written as paths and read: their areas come back."""
    one_ = arcs.around_ring(ring((10, 10), (60, 10), (60, 40)), 5.0)
    two = arcs.circle(100.0, 100.0, 20.0)
    body = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><path d="'), arcs.path_data(one_), F.lit('" fill="#ff0000" stroke="none"/><path d="'), arcs.path_data(two), F.lit('" fill="#00ff00" stroke="none"/></svg>'))
    row = one(spark, body)
    rings = [[(z.real, z.imag) for z in path_ring(d.split('"')[0])] for d in row.c0.split('d="')[1:]]
    assert [abs(shoelace(r)) for r in rings] == pytest.approx([750 + 5 * (80 + math.hypot(50, 30)) + 25 * math.pi, 400 * math.pi], rel=0.01)
