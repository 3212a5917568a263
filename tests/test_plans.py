"""Plans keep to joins by equal keys; kernels against plain versions; the protocol."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest

from pointweave import registry
from pointweave.functions import shapes
from pointweave.operators import arrangement, grids, growth, metrics, pairs, skeleton
from pointweave.plans.protocol import Session
from pointweave.settings import Settings


@pytest.mark.parametrize("name", ["beta_skeleton", "skeleton_crossings", "nearest_other_type", "two_color_first_touch", "point_in_hull", "matching_candidates", "matching_clear"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def clustered(n, seed):
    """Points of very different density, with copies and a far one."""
    r = np.random.default_rng(seed)
    xy = np.concatenate([r.normal(0, 1, (n, 2)), r.normal(50, 20, (n, 2)), [[50, 50]] * 3, [[900, -400]]])
    return pd.DataFrame({"point_id": range(len(xy)), "type": r.integers(0, 3, len(xy)), "x": xy[:, 0], "y": xy[:, 1]}).astype({"type": "int32", "point_id": "int64"})


@pytest.mark.parametrize("beta", [0.534, 1.0, 1.4])
def test_skeleton_against_brute_force(spark, beta):
    p = clustered(40, 3)
    theta, rows = skeleton.angle_limit(beta), list(p.itertuples(index=False))

    def sees(a, b, r):
        if (r.type == a.type) and ((r.x, r.y) in ((a.x, a.y), (b.x, b.y))):
            return False
        v, w = (a.x - r.x, a.y - r.y), (b.x - r.x, b.y - r.y)
        n = math.hypot(*v) * math.hypot(*w)
        return n == 0 or math.acos(max(-1, min(1, (v[0] * w[0] + v[1] * w[1]) / n))) > theta

    want = {(a.point_id, b.point_id) for a in rows for b in rows if a.point_id < b.point_id and a.type == b.type and not any(sees(a, b, r) for r in rows)}
    got = {(r["i"], r["j"]) for r in skeleton.beta_skeleton(spark.createDataFrame(p), beta).collect()}
    assert got == want


def test_nearest_and_first_touch_against_brute_force(spark):
    p = clustered(50, 5)
    rows, df = list(p.itertuples(index=False)), spark.createDataFrame(p)
    d = lambda a, b: math.sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)
    near = {a.point_id: min((d(a, b), b.point_id) for b in rows if b.type != a.type) for a in rows}
    assert {r["point_id"]: (r["d"], r["other_id"]) for r in pairs.nearest_other_type(df).collect()} == near
    touch = {(s, t): min(d(a, b) for a in rows for b in rows if a.type == s and b.type == t) for s in range(3) for t in range(s + 1, 3)}
    assert {(r["type1"], r["type2"]): r["d"] for r in pairs.first_touch(df).collect()} == touch
    assert pairs.nearest_other_type(df.where("type = 1")).count() == 0 and pairs.first_touch(df.where("false")).count() == 0


def test_cells_along_hold_the_segment(spark):
    r = random.Random(4)
    rows = [(k, *[r.uniform(-50, 50) for _ in range(4)]) for k in range(60)] + [(60, 1.0, 1.0, 1.0, 9.0), (61, 2.0, 2.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "k long, ix double, iy double, jx double, jy double")
    cells = {(x["k"], x["__cx"], x["__cy"]) for x in grids.cells_along(df, 1.5, 4.0).collect()}
    for k, ix, iy, jx, jy in rows:
        for t in np.linspace(0, 1, 200):
            x, y = ix + t * (jx - ix), iy + t * (jy - iy)
            for a in np.linspace(0, 2 * math.pi, 9):
                assert (k, math.floor((x + 1.499 * math.cos(a)) / 4), math.floor((y + 1.499 * math.sin(a)) / 4)) in cells


def test_forest_against_plain(spark):
    p = clustered(45, 8)
    p["dataset_id"] = p["point_id"] % 2
    edges = skeleton.beta_skeleton(spark.createDataFrame(p), keys=("dataset_id",)).toPandas()
    got = skeleton.forest(spark.createDataFrame(edges), augment=True).toPandas()

    def cross(e, f):
        den = (e.jx - e.ix) * (f.jy - f.iy) - (e.jy - e.iy) * (f.jx - f.ix)
        if den == 0:
            return False
        t = ((f.ix - e.ix) * (f.jy - f.iy) - (f.iy - e.iy) * (f.jx - f.ix)) / den
        u = ((f.ix - e.ix) * (e.jy - e.iy) - (f.iy - e.iy) * (e.jx - e.ix)) / den
        return 0.01 < t < 0.99 and 0.01 < u < 0.99

    for dataset, own in edges.groupby("dataset_id"):
        left, taken, group = sorted(own.itertuples(index=False), key=lambda e: (e.i, e.j)), [], {}
        find = lambda v: group.get(v, frozenset([v]))
        while left := [e for e in left if find(e.i) != find(e.j)]:
            e = min(left, key=lambda e: (sum(cross(e, f) for f in left if f is not e), e.i, e.j))
            both = find(e.i) | find(e.j)
            group.update(dict.fromkeys(both, both))
            taken.append(e)
            left = [f for f in left if f is not e and not cross(e, f)]
        kept = list(taken)
        for e in sorted(own.itertuples(index=False), key=lambda e: (e.i, e.j)):
            if all((e.i, e.j) != (k.i, k.j) for k in kept) and not any(k.type != e.type and cross(e, k) for k in kept):
                kept.append(e)
        mine = got[got["dataset_id"] == dataset].sort_values("step")
        assert list(zip(mine["i"], mine["j"], strict=True)) == [(e.i, e.j) for e in kept]
        assert (~mine["augmented"]).sum() == len(taken)


def test_measures_of_plain_shapes(spark):
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4.0]])
    star = np.array([[0, 0], [4, 0], [4, 4], [2, 1], [0, 4.0]])
    assert shapes.absolute_curvature(square) == pytest.approx(0) and shapes.perimeter_ratio([square]) == pytest.approx(1, rel=1e-2)
    assert shapes.area_ratio([square]) == pytest.approx(1) and shapes.area_ratio([star]) == pytest.approx(16 / 10)
    inner = math.pi - 2 * math.atan2(2, 3)
    assert shapes.absolute_curvature(star) == pytest.approx(2 * inner)
    assert shapes.perimeter_ratio([star]) == pytest.approx((12 + 2 * math.sqrt(13)) / 16, rel=1e-2)
    fine = shapes.resample(star, 400) * 5
    assert shapes.inflections(square * 9) == 0 and shapes.inflections(fine) == 1
    points = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 1, 0, 10.0, 0.0), (1, 2, 1, 100.0, 0.0)], "dataset_id long, point_id long, type int, x double, y double")
    patterns = spark.createDataFrame([(1, 5, "matching", 0, [0, 1], 5.0), (1, 2, "single", 1, [2], 0.0)], "dataset_id long, pattern_id int, kind string, type int, point_ids array<long>, cover_radius double")
    row = metrics.report(patterns, points, Settings(p_size=1.0)).first()
    one, two = shapes.area(shapes.dilated_hull(np.array([[0, 0], [10, 0.0]]), 3, 8)), shapes.area(shapes.disc(0, 0, 3, 8))
    assert row["n_patterns"] == 2 and row["cover_avg"] == 2.5 and row["cover_max"] == 5.0
    assert row["density_avg"] == pytest.approx(100 * abs(one / (one + two) - 2 / 3)) == pytest.approx(row["density_max"])
    assert row["perimeter_max"] == pytest.approx(1, rel=1e-3) and row["area_max"] == pytest.approx(1) and row["curvature_max"] == pytest.approx(0, abs=1e-9)


def plain_growth(xy, kinds, s):
    """Growth by the definition: all events in a list, the earliest (then the first made) taken again and again."""
    made, live, events, rows = growth.Pattern, {i: growth.Pattern("single", [i], xy) for i in range(len(xy))}, [], []
    r, horizon = s.expand_radius, s.max_time

    def close(p):
        mine = {(*xy[m], kinds[m]) for m in p.members}
        return any(shapes.line_distance(xy[k : k + 1], p.line, p.closed)[0] < s.forbid_too_close * r and (*xy[k], kinds[k]) not in mine for k in range(len(xy)))

    for i in range(len(xy)):
        for j in range(i + 1, len(xy)):
            if kinds[i] == kinds[j] and math.hypot(*(xy[i] - xy[j])) <= 2 * horizon and not close(made("matching", [i, j], xy)):
                events.append((math.hypot(*(xy[i] - xy[j])) / 2, len(events), i, j, made("matching", [i, j], xy)))
    number, step = len(events), 0
    while events:
        event = min(events, key=lambda e: e[:2])
        events.remove(event)
        time, _, a, b, new = event
        if time > horizon:
            break
        if a not in live or b not in live or close(new) or any(new.overlaps(p) for k, p in live.items() if k not in (a, b)):
            continue
        live.pop(a, None), live.pop(b, None)
        step += 1
        rows.append((step, round(time, 9), sorted(new.members), new.kind))
        g = growth.Growth(xy, kinds, s)
        for k, p in live.items():
            if kinds[p.members[0]] == kinds[new.members[0]]:
                g.events = []
                g.offer(-1, new, k, p)
                for t, _, _, _, result, _ in sorted(g.events, key=lambda e: e[1]):
                    events.append((t, number, len(xy) + step - 1, k, result))
                    number += 1
        live[len(xy) + step - 1] = new
    return rows


def test_growth_against_the_definition():
    for seed in range(4):
        r = np.random.default_rng(seed)
        xy, kinds = r.uniform(0, 45, (24, 2)), r.integers(0, 2, 24)
        s = Settings(p_size=1.0, postpone_intersections=False)
        got = [(row[0], round(row[1], 9), sorted(row[7]), row[5]) for row in growth.Growth(xy, kinds, s).run() if row[0]]
        assert got == plain_growth(xy, kinds, s)


def test_delay_is_the_added_area():
    """A point of another type beside a matching: what the matching's region adds on its disc over the two single discs."""
    xy, kinds = np.array([[0, 0], [10, 0], [5, 4.0]]), np.array([0, 0, 1])
    g = growth.Growth(xy, kinds, Settings(p_size=1.0, postpone_intersections=True))
    a, b, both = growth.Pattern("single", [0], xy), growth.Pattern("single", [1], xy), growth.Pattern("matching", [0, 1], xy)
    r = np.random.default_rng(0)
    p = xy[2] + r.uniform(-3, 3, (200_000, 2))
    disc = np.hypot(*(p - xy[2]).T) < 3
    new = shapes.segment_distance(p, xy[:1], xy[1:2])[:, 0] < 3
    old = (np.hypot(*(p - xy[0]).T) < 3) | (np.hypot(*(p - xy[1]).T) < 3)
    added = 36 * ((disc & new).mean() - (disc & old).mean())
    assert g.intersection_delay(a, b, both) == pytest.approx(math.sqrt(added / math.pi), rel=0.03)


def test_long_chains_have_an_order():
    n = 5000
    assert arrangement.topological_order(n, {(k, k + 1) for k in range(n - 1)}) == list(range(n))
    assert arrangement.topological_order(n, {(k, (k + 1) % n) for k in range(n)}) is None


def test_preferences():
    assert arrangement.preference((1, 2), (False, True), (True, False)) == "GT"
    assert arrangement.preference((1, 1), (True, False), (False, True)) == "LT"
    assert arrangement.preference((1, 1), (True, True), (False, True)) == "GT"
    assert arrangement.preference((0, 0), (False, False), (True, True)) == "EQ"
    line = np.array([[0, 0], [10, 0.0]])
    assert arrangement.inside_disc(line, 5, 0, 2).tolist() == [[3, 0], [7, 0]] and arrangement.inside_disc(line, 5, 9, 2) is None
    squares = [np.array([[0, 0], [4, 0], [4, 4], [0, 4.0]]), np.array([[2, 1], [9, 1], [9, 3], [2, 3.0]])]
    a = arrangement.Arrangement(squares)
    ((_, _, faces),) = a.overlaps()
    assert [len(x) for x in a.parts(faces, 1)] == [4] and [len(x) for x in a.parts(faces, 0)] == [2]
    assert sum(len(x) - 1 for x in a.parts(faces, 1, outer=True)) == 3


def test_requests(spark):
    session = Session(spark)
    assert session.serve(json.dumps({"kind": "draw"})) is None
    points = [{"dataset_id": 1, "point_id": k, "type": k % 2, "x": 6.0 * (k // 2), "y": 30.0 * (k % 2)} for k in range(6)]
    ask = {"kind": "compute", "points": points, "settings": {"p_size": 1.0, "postpone_intersections": False, "cover": 3.0}}
    first = json.loads(session.serve(json.dumps(ask)).first()["value"])
    assert first["kind"] == "completed" and first["svg"].count("<circle") == 6 and session.growths == 1
    session.serve(json.dumps({"kind": "change_cover", "cover": 0.5}))
    again = json.loads(session.serve(json.dumps(ask | {"settings": ask["settings"] | {"cover": 0.5}})).first()["value"])
    assert session.growths == 1 and again["svg"].count("<path") == 6 > first["svg"].count("<path")
    with pytest.raises(ValueError):
        session.serve('{"kind": "other"}')
