"""Trees in drawings, boxes that meet, and progress."""

import json
import random

from pyspark.sql import functions as F

from pointweave.operators.grids import boxes_meet
from pointweave.operators.growth import grow
from pointweave.plans.protocol import Session
from pointweave.settings import Settings
from pointweave.sources import drawing
from pointweave.sources.svg import parse_svg


def test_nested_groups_are_read_again(spark):
    """Fills and strokes come from groups; their tags nest, and an element after a group isn't in it."""
    dot = lambda x: f'<circle cx="{x}" cy="5" r="1.0"/>'
    nodes = [
        ([0], {"stroke": "#000000", "note": 'a"b&c'}, None),
        ([0, 0], {"fill": drawing.hex_color(drawing.PALETTE[1])}, None),
        ([0, 0, 0], {}, dot(1)),
        ([0, 0, 10], {}, dot(2)),
        ([0, 0, 2], {}, dot(3)),
        ([0, 1], {"fill": drawing.hex_color(drawing.PALETTE[2])}, None),
        ([0, 1, 0], None, None),
        ([0, 1, 0, 0], {}, dot(4)),
        ([1], {"fill": drawing.hex_color(drawing.PALETTE[3]), "stroke": "#000000"}, None),
        ([1, 0], {}, dot(5)),
        ([2], {}, None),
    ]
    random.Random(1).shuffle(nodes)
    df = spark.createDataFrame([(7, p, a, s) for p, a, s in nodes], "dataset_id long, path array<int>, attributes map<string,string>, svg string")
    text = drawing.tree_svg(df)
    body = text.first()["document"]
    assert body.count("<g") == body.count("</g>") == 6 and body.index("</g>") > body.index("<g")
    order = [row.path for row in drawing.visits(df).where("visit = 'PRE'").orderBy("at").collect()]
    assert order == sorted(p for p, _, _ in nodes)
    points, _ = parse_svg(text.select("dataset_id", F.col("document").alias("value")), 1.0)
    assert [(row.x, row.type) for row in points.orderBy("x").collect()] == [(1.0, 1), (2.0, 1), (3.0, 1), (4.0, 2), (5.0, 3)]


def test_boxes_that_meet(spark):
    r = random.Random(5)
    box = lambda: (lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)])(r.uniform(0, 100), r.uniform(0, 100), r.choice([0, 1, 5, 60]) * r.random(), r.choice([0, 1, 5, 60]) * r.random())
    rows = [(k % 2, k, box()) for k in range(160)]
    df = spark.createDataFrame(rows, "d int, i int, ring array<struct<x:double,y:double>>")
    got = boxes_meet(df, df.select("d", F.col("i").alias("j"), F.col("ring").alias("other")), ("d",)).select("i", "j").collect()
    want = [(i, j) for d, i, a in rows for e, j, b in rows if d == e and a[0][0] <= b[2][0] and b[0][0] <= a[2][0] and a[0][1] <= b[2][1] and b[0][1] <= a[2][1]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_growth_tells_its_progress(spark):
    rows = [(1, i, 0, 300.0 * (i // 2), 5.0 * (i % 2)) for i in range(24)]
    points = spark.createDataFrame(rows, "dataset_id long, point_id long, type int, x double, y double")
    shares = []
    history = grow(points, Settings(p_size=2.0, cover=3.0, postpone_intersections=False), progress=shares.append)
    assert history.where("seq > 0").count() == 12
    assert shares == sorted(shares) and shares[-1] == 1.0
    lines = []
    request = {"kind": "compute", "points": [dict(zip(("dataset_id", "point_id", "type", "x", "y"), r, strict=True)) for r in rows[:4]], "settings": {"p_size": 2.0}}
    Session(spark, lines.append).serve(json.dumps(request))
    assert json.loads(lines[-1]) == {"kind": "progress", "progress": 1.0}
