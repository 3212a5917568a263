"""Nearest things, lookups on drawings, fill rules, drawing by face and growth by groups against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointweave.functions import booleans
from pointweave.functions.planar import ring_area
from pointweave.operators import clipping, descent, face_drawing, lookups
from pointweave.operators.growth import Growth, cut, grow, reach, reach_groups
from pointweave.operators.numbering import numbered
from pointweave.operators.planar_map import PlanarMap
from pointweave.settings import Settings
from test_planar_map import stars, table


def points_of(spark, rows):
    return spark.createDataFrame(rows, "point_id long, type int, x double, y double")


def test_nearest_of_other_types(spark):
    r = random.Random(7)
    rows = [(i, r.randrange(3), r.choice([0.0, 90.0]) + r.gauss(0, 3), r.gauss(0, 3)) for i in range(200)] + [(1000, 0, 0.0, 0.0), (1001, 1, 0.0, 0.0), (1002, 1, 0.0, 0.0)]
    want = {}
    for i, t, x, y in rows:
        d, j = min((math.hypot(x - u, y - v), j) for j, s, u, v in rows if s != t)
        want[i] = (j, pytest.approx(d))
    got = {row.point_id: (row.other_id, row.d) for row in descent.nearest_of_other_class(points_of(spark, rows)).collect()}
    assert got == want
    touch = {(row.type1, row.type2): row.d for row in descent.least_distances(points_of(spark, rows)).collect()}
    assert touch == {(a, b): pytest.approx(min(math.hypot(x - u, y - v) for _, s, x, y in rows if s == a for _, t, u, v in rows if t == b)) for a in range(3) for b in range(a + 1, 3)}
    one_type = points_of(spark, [r for r in rows if r[1] == 0])
    assert descent.nearest_of_other_class(one_type).count() == 0 and descent.least_distances(one_type).count() == 0


def test_far_dense_clusters_meet_where_they_face_each_other(spark, monkeypatch):
    """Two clusters of 1500 points each, of one type each, far apart: not all pairs meet."""
    r = random.Random(8)
    n = 1500
    rows = [(i, i % 2, (i % 2) * 10_000 + r.random() * 100, r.random() * 100) for i in range(2 * n)]
    met = []
    real = descent._descend
    monkeypatch.setattr(descent, "_descend", lambda *a: met.append(real(*a)) or met[-1])
    found = descent.nearest_of_other_class(points_of(spark, rows)).collect()
    assert len(found) == 2 * n
    # The askers of a cell meet the points of few cells.
    held = met[0].groupBy("type", "ax", "ay").count().agg(F.avg("count")).first()[0]
    cells = met[0].select("ax", "ay").distinct().count()
    assert held < cells / 4


def test_nearest_sides_and_distances(spark):
    rings = stars(3, 12, 60)
    flat = [(k, p, q) for k, ring in enumerate(rings) for p, q in zip(ring, ring[1:] + ring[:1])]
    r = random.Random(1)
    places = [(i, r.uniform(-300, 400), r.uniform(-20, 80)) for i in range(60)]

    def gap(x, y, p, q):
        ux, uy = q[0] - p[0], q[1] - p[1]
        t = max(0, min(1, ((x - p[0]) * ux + (y - p[1]) * uy) / (ux * ux + uy * uy)))
        return math.hypot(p[0] + t * ux - x, p[1] + t * uy - y)

    at = spark.createDataFrame(places, "place_id long, x double, y double")
    got = {row.place_id: row for row in lookups.nearest(at, table(spark, {1: rings})).collect()}
    near = {(row.place_id, row.ring_id): row.d for row in lookups.distances(at, table(spark, {1: rings}), 40.0).collect()}
    for i, x, y in places:
        d, k = min((gap(x, y, p, q), k) for k, p, q in flat)
        assert (got[i].d, got[i].ring_id) == (pytest.approx(d), k)
        assert math.hypot(got[i].nx - x, got[i].ny - y) == pytest.approx(d)
        for k in range(len(rings)):
            own = min(gap(x, y, p, q) for j, p, q in flat if j == k)
            assert ((i, k) in near) == (own <= 40.0)
            assert own > 40.0 or near[i, k] == pytest.approx(own)


def test_cuts_are_merged_in_order(spark):
    r = random.Random(4)
    rows = [(r.randrange(2), i, r.uniform(0, 4), r.uniform(0, 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, o int, x double, y double")
    want = []
    for k, o, x, y in rows:
        if all(k != b or math.hypot(x - u, y - v) >= 0.5 for b, _, u, v in want):
            want.append((k, o, x, y))
    assert sorted(map(tuple, lookups.first_of_near(df, 0.5, ["k"], ["o"]).collect())) == sorted(want)
    assert lookups.first_of_near(df.where("false"), 0.5, ["k"], ["o"]).count() == 0
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    a, b = table(spark, {1: [square]}), table(spark, {1: [[(5, 5), (15, 5), (15, 15), (5, 15)], [(5.2, 5.1), (20, 5.1), (20, 20), (5.2, 20)]]})
    assert sorted((row.ring_id, row.t) for row in lookups.intersections(a, b, merge=0.0).collect()) == [(0, pytest.approx(1.5)), (0, pytest.approx(2.5)), (1, pytest.approx(1.51)), (1, pytest.approx(2.48))]
    assert [(row.ring_id, row.t) for row in lookups.intersections(a, b).orderBy("t").collect()] == [(0, pytest.approx(1.5)), (1, pytest.approx(2.48))]
    left = lookups.difference(a, table(spark, {1: [[(2, 2), (4, 2), (4, 4), (2, 4)], [(8, 8), (12, 8), (12, 12), (8, 12)]]})).select(ring_area(F.col("ring")).alias("s")).collect()
    assert sorted(round(row.s, 6) for row in left) == [-4, 96]


def test_fill_rules_against_the_kernel(spark):
    rings = stars(6, 8, 25)
    rings = [ring[::-1] if k % 3 == 0 else ring for k, ring in enumerate(rings)]
    m = PlanarMap(table(spark, {1: rings}).withColumn("clip", F.col("ring_id") % 2 == 1))
    got = {(row.operation, row.rule): row.area for row in clipping.clip_areas(m, F.col("clip")).collect()}
    arrays = [np.array(r, float) for r in rings]
    area = lambda f: booleans.rings_area(booleans.boolean(arrays, f))
    even, odd = (lambda s: s[0::2].sum(axis=0) % 2 == 1), (lambda s: s[1::2].sum(axis=0) % 2 == 1)
    assert got["union", "even_odd"] == pytest.approx(area(lambda s: even(s) | odd(s)), rel=1e-6)
    assert got["difference", "even_odd"] == pytest.approx(area(lambda s: even(s) & ~odd(s)), rel=1e-6)
    turns = np.array([1 if booleans.rings_area is None or sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1])) > 0 else -1 for r in rings])
    wind = lambda s, k: (s[k::2] * turns[k::2, None]).sum(axis=0)
    for rule, test in (("non_zero", lambda w: w != 0), ("positive", lambda w: w > 0), ("negative", lambda w: w < 0)):
        want = area(lambda s, test=test: test(wind(s, 0)) & test(wind(s, 1)))
        assert got.get(("intersection", rule), 0.0) == pytest.approx(want, rel=1e-6, abs=1e-6)
    depth = clipping.depth_areas(m).first()
    assert depth.any_area == pytest.approx(area(lambda s: s.any(axis=0)), rel=1e-6)
    chosen = clipping.chosen(clipping.windings(m, F.col("clip")), "union", "non_zero").select("face")
    around = clipping.outlines(m, chosen).select(F.sum(ring_area(F.col("ring")))).first()[0]
    assert around == pytest.approx(m.union_areas(chosen).first().area)


def test_faces_of_a_circle_of_regions(spark):
    """Three boxes, each above the next one around: no order of all three, but one in each face of two."""
    rings = [[(0, 0), (6, 0), (6, 4), (0, 4)], [(4, 0), (10, 0), (10, 4), (4, 4)], [(5, 2), (12, 2), (12, 6), (-2, 6), (-2, 3), (5, 3)]]
    m = PlanarMap(table(spark, {1: rings}))
    above = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0)], "dataset_id long, over int, under int")
    layers = face_drawing.face_layers(m, above)
    top = {tuple(row.origins): row.top for row in m.faces.join(face_drawing.tops(layers), "face").collect()}
    assert top[(0, 1)] == 0 and top[(1, 2)] == 1 and top[(0, 2)] == 2 and (0, 1, 2) not in top
    part = m.faces.where(F.array_contains("origins", 0) & F.array_contains("origins", 1) & (F.size("origins") == 2)).select("face", F.lit(0).alias("ring_id"))
    seen = face_drawing.face_layers(m, above, part).join(part.select("face"), "face").where("visible").select("ring_id").distinct().collect()
    assert sorted(row.ring_id for row in seen) == [0, 1]  # the one below shows where the top doesn't fill the face
    types = table(spark, {1: rings}).select("dataset_id", "ring_id", F.col("ring_id").alias("type"))
    parts = [row.z.part for row in face_drawing.elements(m, layers, types).orderBy("z").collect()]
    assert set(parts) == {0, 1, 2} and parts == sorted(parts)


def plain_history(pdf, s):
    rows = []
    for d, g in pdf.groupby("dataset_id"):
        g = g.sort_values("point_id")
        ids = g["point_id"].to_numpy()
        rows += [(d, r[0], round(r[1], 6), *r[2:7], tuple(int(ids[m]) for m in r[7]), round(r[8], 6)) for r in Growth(g[["x", "y"]].to_numpy(float), g["type"].to_numpy(), s).run()]
    return sorted(rows, key=str)


def test_growth_by_groups(spark):
    """A dataset of clusters makes many groups, and the history of one loop over all of it."""
    r = random.Random(11)
    rows = []
    for d, clusters in ((1, 9), (2, 4)):
        for c in range(clusters):
            x, y = 400 * (c % 3), 400 * (c // 3)
            for _ in range(r.randint(1, 8)):
                rows.append((d, len(rows) * 3 + 7, r.randrange(2), x + r.gauss(0, 9), y + r.gauss(0, 9)))
    points = spark.createDataFrame(rows, "dataset_id long, point_id long, type int, x double, y double")
    for s in (Settings(p_size=2.0, cover=3.0), Settings(p_size=2.0, cover=3.0, postpone_intersections=False, forbid_too_close=0.3)):
        groups = reach_groups(points, reach(s)).select("dataset_id", "gx", "gy").distinct().groupBy("dataset_id").count()
        assert {row.dataset_id: row["count"] for row in groups.collect()} == {1: 9, 2: 4}
        history = grow(points, s)
        got = sorted(((x.dataset_id, x.seq, round(x.time, 6), x.pattern_id, x.left_id, x.right_id, x.kind, x.type, tuple(x.point_ids), round(x.cover_radius, 6)) for x in history.collect()), key=str)
        assert got == plain_history(points.toPandas(), s)
        left = cut(history, s.cover * s.expand_radius)
        assert left.selectExpr("explode(point_ids)").distinct().count() == len(rows)
    assert grow(points.where("false"), s).count() == 0


def test_numbers_in_order(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), i, r.choice([0.0, 1.5, r.gauss(0, 9)])) for i in range(400)]
    df = numbered(spark.createDataFrame(rows, "k int, i int, v double"), "k", F.col("v"), ["v", "i"], "n")
    want = pd.DataFrame(rows, columns=["k", "i", "v"]).sort_values(["k", "v", "i"])
    want["n"] = want.groupby("k").cumcount()
    assert sorted((x.k, x.i, x.n) for x in df.collect()) == sorted(want[["k", "i", "n"]].itertuples(index=False, name=None))
