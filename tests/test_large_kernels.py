"""Kernels that have to hold at size: discs, forests, components, unions by tiles, stacking."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pointweave.functions import shapes
from pointweave.operators import arrangement, circles, skeleton
from pointweave.settings import Settings


def test_discs_meet_few(monkeypatch):
    r = np.random.default_rng(2)
    a, b = r.normal(0, 30, (1500, 2)), r.normal(0, 30, (1500, 2))
    seen = []
    real = circles._grow
    monkeypatch.setattr(circles, "_grow", lambda c, m, pairs: seen.append(len(pairs)) or real(c, m, pairs))
    got = circles.grow_two(a[:200], b[:200], 9.0, 5.0)
    every = real(np.concatenate([a[:200], b[:200]]), np.repeat([9.0, 5.0], 200), [(i, 200 + j) for i in range(200) for j in range(200)])
    assert (np.concatenate(got) == every).all()
    circles.grow_two(a, b, 9.0, 5.0)
    assert seen[-1] < 10 * 1500  # all pairs are 2,250,000


def test_forest_of_many_edges():
    r = np.random.default_rng(3)
    xy, kind = r.uniform(0, 400, (8000, 2)), r.integers(0, 5, 8000)
    cells = {}
    for k, (x, y) in enumerate(xy):
        cells.setdefault((x // 8, y // 8), []).append(k)
    edges = sorted({(min(i, j), max(i, j)) for some in cells.values() for i in some for j in some if i != j})
    edges = [(i, j, *xy[i].tolist(), *xy[j].tolist(), int(kind[i])) for i, j in edges]
    began = time.time()
    met = skeleton._meetings(edges)
    taken = skeleton._forest(edges, met)
    assert time.time() - began < 20  # all pairs of about 13,000 edges took minutes
    numbers, begins = met
    chosen = set(taken)
    assert len(edges) > 10_000 and not any(m in chosen for k in taken for m in numbers[begins[k] : begins[k + 1]])


def test_components_find_edges_once_and_broadcast_nothing(spark):
    looked = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            looked.add(len(pdf))
            yield pdf

    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40, 2)], "i long, j long").mapInPandas(count, "i long, j long")
    found = skeleton.components(spark.range(41).select(F.col("id").alias("point_id")), edges)
    assert {r.point_id: r.component for r in found.collect()} == {k: k - k % 2 for k in range(41)}
    assert looked.value == 20


def test_convex_union_by_tiles():
    r = np.random.default_rng(4)
    regions = [g for _ in range(40) for g in shapes.dilate("bank", r.normal(0, 25, (1, 2)) + r.normal(0, 8, (3, 2)), 6.0, 8)]
    tiles = sum(shapes.convex_union_area(regions, (x, y, x + 40, y + 40)) for x in range(-160, 160, 40) for y in range(-160, 160, 40))
    assert abs(tiles - shapes.union_area(regions)) < 1e-6
    crowd = [shapes.disc(*p, 12.0, 8) for p in r.uniform(0, 90, (3000, 2))]
    began = time.time()
    assert abs(shapes.convex_union_area(crowd, (20, 20, 70, 70)) - 2500) < 1e-9
    assert time.time() - began < 10


def test_stacking_of_a_crowd(spark):
    r = np.random.default_rng(6)
    xy = r.uniform(0, 150, (90, 2))
    s = Settings(p_size=4.0, cover=4.0)
    pdf = pd.DataFrame({"pattern_id": range(90), "kind": "single", "xy": [p.reshape(1, 2) for p in xy]})
    relations, order = arrangement.stack(pdf, s)
    without, places = arrangement.stack(pdf, s, outlines=False)
    assert without.equals(relations) and places["z"].equals(order["z"])
    patterns = spark.createDataFrame([(1, k, "single", 0, [k]) for k in range(90)], "dataset_id long, pattern_id int, kind string, type int, point_ids array<long>")
    points = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(xy)], "dataset_id long, point_id long, x double, y double")
    bent = {p.pattern_id: [(c.x, c.y) for c in p.ring] for p in arrangement.arrange(patterns, points, s).collect()}
    assert bent == {i: [(c["x"], c["y"]) for c in ring] for i, ring in zip(order["pattern_id"], order["ring"], strict=True)}
    a = arrangement.Arrangement([shapes.disc(*p, 12.0, 8) for p in xy])
    pairs = {(i, j) for i, j, _ in a.overlaps()}
    assert pairs == {(i, j) for f in a.faces for i in f.origins for j in f.origins if i < j}
    sets = {f.origins for f in a.faces if len(f.origins) > 2}
    assert arrangement.prune(sets) == {e for e in sets if not any(len(f) == len(e) + 1 and e < f for f in sets)}
