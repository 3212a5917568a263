"""The registered field queries against brute force on a small table, at the resolution of the operators."""

import pandas as pd
import pytest

from pointweave import registry
from pointweave.operators.fields import constants

# Type 1 stands around a point of type 0: its positive region has no node of a grid of 10 or 20.
POINTS = [(0, 4.0, 4.0), (1, 10.0, 4.0), (1, 4.0, 10.0), (1, -2.0, 4.0), (1, 4.0, -2.0), (2, 200.0, 33.0), (2, 215.0, 33.0)]
STEP = 2.5


@pytest.fixture(scope="module")
def small_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("fields")
    pd.DataFrame({"vec_id": range(len(POINTS)), "embedding": [[x / 1000, y / 1000] for _, x, y in POINTS], "label": pd.array([t for t, _, _ in POINTS], dtype="int32")}).to_parquet(d / "embeddings.parquet")
    return str(d)


def plain():
    """(influence, potential) by (type, ix, iy)."""
    m, t = constants()
    influence = {}
    for ix in range(-60, 130):
        for iy in range(-60, 130):
            for kind, x, y in POINTS:
                d2 = (ix * STEP - x) ** 2 + (iy * STEP - y) ** 2
                if d2 < 1 / m:
                    influence[kind, ix, iy] = influence.get((kind, ix, iy), 0) + 1 / d2 - m
    total = {}
    for (_, ix, iy), v in influence.items():
        total[ix, iy] = total.get((ix, iy), 0) + v
    return influence, {k: 2 * v - total[k[1:]] - t for k, v in influence.items()}


def test_grids_at_full_resolution(spark, small_dir):
    for name, want in zip(("influence_grid", "potential_grid"), plain(), strict=True):
        found = {tuple(r)[:3]: r[3] for r in registry.QUERIES[name](spark, small_dir).collect()}
        assert found.keys() == want.keys()
        assert all(found[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_sign_cells_at_full_resolution(spark, small_dir):
    up = {k for k, v in plain()[1].items() if v > 0}
    cells = {(t, x - dx, y - dy) for t, x, y in up for dx in (0, 1) for dy in (0, 1)}
    masks = {(t, x, y): sum(bit for dx, dy, bit in ((0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)) if (t, x + dx, y + dy) in up) for t, x, y in cells}
    found = {tuple(r)[:3]: r[3] for r in registry.QUERIES["potential_sign_cells"](spark, small_dir).collect()}
    assert found == {k: v for k, v in masks.items() if v < 15}


def test_no_member_is_lost_between_nodes(spark, small_dir):
    assert {r["point_id"] for r in registry.QUERIES["potential_members"](spark, small_dir).collect()} == set(range(len(POINTS)))
    assert {r["type"] for r in registry.QUERIES["potential_contours"](spark, small_dir).collect()} == {0, 1, 2}


def test_types_without_a_contour(spark):
    from pointweave.operators.contours import zero_contours

    points = spark.createDataFrame([(0, 0, 4.0, 4.0)], "point_id long, type int, x double, y double")
    assert zero_contours(points, 10.0, vertex=1.0).count() == 0
