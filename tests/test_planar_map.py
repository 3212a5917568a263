"""Arrangements, faces, border runs and zero contours as tables, against kernels that walk and plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import shapes
from pointweave.functions.planar import ring_area
from pointweave.operators import arrangement, contours, grids
from pointweave.operators.cycles import cycles
from pointweave.operators.planar_map import PlanarMap

RING = "dataset_id long, ring_id int, ring array<struct<x:double,y:double>>"


def table(spark, datasets):
    return spark.createDataFrame([(d, k, [(float(x), float(y)) for x, y in r]) for d, rings in datasets.items() for k, r in enumerate(rings)], RING)


def stars(seed, n, spread):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        cx, cy, size, k = r.uniform(0, spread), r.uniform(0, spread), r.choice([1, 4, 30]), r.randint(3, 9)
        out.append([(cx + size * r.uniform(0.4, 1) * math.cos(2 * math.pi * i / k), cy + size * r.uniform(0.4, 1) * math.sin(2 * math.pi * i / k)) for i in range(k)])
    return out


def test_cycles_against_a_walk(spark):
    r = random.Random(1)
    nodes = list(range(500))
    r.shuffle(nodes)
    cuts = sorted(r.sample(range(1, 500), 20)) + [500]
    to, lo = {}, 0
    for hi in cuts:
        for k in range(lo, hi):
            to[nodes[k]] = nodes[k + 1] if k + 1 < hi else nodes[lo]
        lo = hi
    got = {row.node: (row.cycle, row.place) for row in cycles(spark.createDataFrame(list(to.items()), "node long, next long")).collect()}
    want = {}
    for v in sorted(to):
        if v not in want:
            w, k = v, 0
            while w not in want:
                want[w] = (v, k)
                w, k = to[w], k + 1
    assert got == want
    assert cycles(spark.createDataFrame([], "node long, next long")).count() == 0


def test_map_against_the_kernel(spark):
    datasets = {1: stars(1, 14, 40), 2: stars(2, 5, 300), 3: [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (8, 2), (8, 8), (2, 8)]], 4: [[(0, 0), (1, 0), (0, 1)]] * 2, 5: [[(3, 3)] * 4]}
    m = PlanarMap(table(spark, datasets))
    faces, overlaps = {}, {}
    counts = {row.dataset_id: tuple(row)[1:] for row in m.counts().collect()}
    for row in m.faces.collect():
        faces.setdefault(row.dataset_id, Counter())[tuple(row.origins), row.n_edges, round(row.area, 4)] += 1
    groups = m.overlaps.join(m.faces.select("face", "area"), "face").groupBy("dataset_id", "i", "j", "component").agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area"))
    for row in groups.collect():
        overlaps.setdefault(row.dataset_id, Counter())[row.i, row.j, row.n, row.area] += 1
    for d, rings in datasets.items():
        a = arrangement.Arrangement([np.array(r, float) for r in rings])
        assert counts[d] == (len(a.crossings), len(a.edges), len(a.faces))
        assert faces.get(d, Counter()) == Counter((tuple(sorted(f.origins)), len(f.halves), round(shapes.area(f.ring), 4)) for f in a.faces)
        assert overlaps.get(d, Counter()) == Counter((i, j, len(fs), round(sum(shapes.area(f.ring) for f in fs), 3)) for i, j, fs in a.overlaps())
    lines = m.outlines().join(m.faces.select("face", "area"), "face").select("area", ring_area(F.col("ring")).alias("own")).collect()
    assert all(row.area == pytest.approx(row.own, abs=1e-6) for row in lines)
    net = {tuple(row.origins): row.area for row in m.net_areas().where("dataset_id = 3").collect()}
    assert net == {(0,): pytest.approx(64), (0, 1): pytest.approx(36)}


def test_border_runs(spark):
    cross = [[(0, 4), (12, 4), (12, 8), (0, 8)], [(4, 0), (8, 0), (8, 12), (4, 12)]]
    comb = [[(0, 0), (12, 0), (12, 2), (0, 2)], [(1, 1), (3, 1), (3, 5), (9, 5), (9, 1), (11, 1), (11, 6), (1, 6)]]
    inside = [[(0, 0), (9, 0), (9, 9), (0, 9)], [(4, 4), (5, 4), (5, 5), (4, 5)]]
    m = PlanarMap(table(spark, {1: cross, 2: comb, 3: inside}))
    found = {}
    for row in m.boundary_parts().collect():
        found.setdefault(row.dataset_id, []).append((row.ring, row.n_parts, round(row.length, 6)))
    assert {d: sorted(v) for d, v in found.items()} == {1: [(0, 2, 8.0), (1, 2, 8.0)], 2: [(0, 1, 2.0), (0, 1, 2.0), (1, 1, 4.0), (1, 1, 4.0)], 3: [(0, 0, 0.0), (1, 1, 4.0)]}
    # Two overlaps of a comb are components of their own; each border is one loop.
    assert m.boundaries.where("dataset_id = 2").select("component", "loop").distinct().count() == 2


def test_one_dataset_takes_many_tasks(spark):
    """One dataset of 5,000 sides: no group holds it, and sides meet in a number of pairs like their own."""
    side = 30
    rings = [[(x, y), (x + 1.5, y), (x + 1.5, y + 1.5), (x, y + 1.5)] for x in range(side) for y in range(side)]
    m = PlanarMap(table(spark, {1: rings + stars(5, 300, 30.0)}))
    squares = PlanarMap(table(spark, {1: rings}))
    row = squares.counts().first()
    n = side * side
    # Each square overlaps its right, upper and two diagonal neighbours, whose outlines cross twice.
    pairs = 2 * side * (side - 1) + 2 * (side - 1) ** 2
    assert row.n_vertices <= 2 * pairs and row.n_faces >= n
    plan = m.crossings._jdf.queryExecution().toString() + m.next._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert m.faces.select("face").distinct().count() == m.faces.count()


def test_one_wide_ring_brings_no_points_from_afar(spark):
    points = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(2000)], "dataset_id long, point_id long, x double, y double")
    rings = table(spark, {1: [[(0, -1), (2000, -1), (2000, 1), (0, 1)]] + [[(i, -1), (i + 0.9, -1), (i + 0.9, 1), (i, 1)] for i in range(0, 2000, 4)]})
    got = grids.within_boxes(points, rings, ("dataset_id",))
    assert got.count() == 2000 + 500
    join = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in join
    assert grids.within_boxes(points, rings.where("false"), ("dataset_id",)).count() == 0


def marched(values, step, outside):
    """(number of corners, area) of each ring, by a walk along cells."""
    get = lambda x, y: min(values.get((x, y), outside), 1e12)
    links = {}
    for x, y in {(x - dx, y - dy) for (x, y), v in values.items() if v > 0 for dx in (0, 1) for dy in (0, 1)}:
        corner = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
        up = [get(*c) > 0 for c in corner]
        for k in range(4):
            if up[k] and not up[(k + 1) % 4]:
                n = k
                while not (up[(n + 1) % 4] and not up[n]):
                    n = (n - 1) % 4
                links[frozenset((corner[k], corner[(k + 1) % 4]))] = frozenset((corner[n], corner[(n + 1) % 4]))
    out = []
    while links:
        e, ring = next(iter(links)), []
        while e in links:
            (x0, y0), (x1, y1) = sorted(e)
            t = get(x0, y0) / (get(x0, y0) - get(x1, y1))
            ring.append(((x0 + t * (x1 - x0)) * step, (y0 + t * (y1 - y0)) * step))
            e = links.pop(e)
        area = sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(len(ring))) / 2
        out.append((len(ring), round(area, 5)))
    return sorted(out)


def test_contours_against_a_walk(spark):
    from pointweave.operators.fields import constants, potential_grid

    r = random.Random(3)
    points = [(i, r.randrange(3), r.gauss(0, 60), r.gauss(0, 60)) for i in range(40)] + [(100, 0, 10.0, 20.0), (101, 1, -30.0, 40.0), (102, 2, -30.0, 40.0)]
    points += [(200 + k, 4, 500 + 70 * math.cos(k), 500 + 70 * math.sin(k)) for k in range(24)]  # a ring with a hole
    p = spark.createDataFrame(points, "point_id long, type int, x double, y double")
    for step in (5.0, 2.5):
        values = {}
        for row in potential_grid(p, step).collect():
            assert not math.isnan(row.potential)
            values.setdefault(row.type, {})[row.ix, row.iy] = row.potential
        found = {}
        for row in contours.zero_contours(p, step).withColumn("signed", ring_area(F.col("ring"))).collect():
            assert row.area == abs(row.signed)
            found.setdefault(row.type, []).append((len(row.ring), round(row.signed, 5)))
        _, t = constants()
        for kind, own in values.items():
            assert [n for n, _ in sorted(found.get(kind, []))] == [n for n, _ in marched(own, step, -t)]
            assert [a for _, a in sorted(found.get(kind, []))] == pytest.approx([a for _, a in marched(own, step, -t)], abs=1e-4)
    assert any(a < 0 for _, a in found[4])  # around the hole, clockwise
