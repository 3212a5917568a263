"""Parsing and writing of points, regions and drawings."""

import pytest
from pyspark.sql import functions as F

from pointweave.functions.planar import ring_area, ring_contains, round_half_up
from pointweave.settings import good_settings, settings_table
from pointweave.sources import drawing, points as src, svg
from pointweave.streaming import regrow

IPE = """<?xml version="1.0"?>
<!DOCTYPE ipe SYSTEM "ipe.dtd">
<ipe><page>
<use name="mark/fdisk(sfx)" pos="10 20" size="normal" fill="foo"/>
<use matrix="1 0 0 1 5 -5" name="mark/fdisk(sfx)" pos="1 2" fill="CB light red"/>
<use name="mark/fdisk(sfx)" pos="3 4" fill="bar"/>
<path fill="CART 2" stroke="black">
0 0 m
4 0 l
4 4 l
h
</path>
</page></ipe>"""


def test_text_points(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 1.5 2\n\n3 -1 0.25 more\n")
    rows = src.read_points(spark, str(tmp_path / "a.txt")).orderBy("point_id").collect()
    assert [(r["type"], r["x"], r["y"]) for r in rows] == [(0, 1.5, 2.0), (3, -1.0, 0.25)]
    (tmp_path / "b.txt").write_text("0 1 2\nx y z\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        src.read_points(spark, str(tmp_path / "b.txt")).collect()
    assert src.read_points(spark, str(tmp_path / "b.txt"), "PERMISSIVE").count() == 1


def test_ipe(spark, tmp_path):
    (tmp_path / "a.ipe").write_text(IPE)
    rows = src.read_points(spark, str(tmp_path / "a.ipe")).orderBy("point_id").collect()
    assert [(r["type"], r["x"], r["y"]) for r in rows] == [(7, 10.0, 20.0), (1, 6.0, -3.0), (8, 3.0, 4.0)]
    region = src.ipe_regions(spark.read.text(str(tmp_path / "a.ipe"), wholetext=True))
    r = region.select("color", "closed", F.abs(ring_area(F.col("ring"))).alias("a"), ring_contains(F.col("ring"), F.lit(3.0), F.lit(1.0)).alias("c")).collect()
    assert [tuple(x) for x in r] == [("CART 2", True, 8.0, True)]


def test_rounding(spark):
    df = spark.createDataFrame([(-0.0005,), (0.0005,)], "v double")
    assert [r[0] for r in df.select(round_half_up(F.col("v"))).collect()] == [0.0, 0.001]


def test_drawing(spark):
    p = spark.createDataFrame([(0, 1, 1.0, 2.0), (1, 99, 3.0, 4.0)], "point_id long, type int, x double, y double")
    marks = p.select(F.lit(1).alias("dataset_id"), F.col("point_id").alias("z"), drawing.ipe_mark(F.col("x"), F.col("y"), F.col("type")).alias("ipe"))
    text = drawing.ipe_page(marks).first()["document"]
    assert text.index('pos="1.000 2.000"') < text.index('pos="3.000 4.000"') and "CART 100" in text
    assert p.select(drawing.color_of(F.col("type"))).collect()[1][0] == "#ffffff"


def test_settings(spark):
    assert good_settings("nyc").cover == 4.87 and settings_table(spark).count() == 10


def test_regrow_stream(spark, tmp_path):
    p = spark.createDataFrame([(d, i, 0, float(6 * i), 0.0) for d in (1, 2) for i in range(3)], "dataset_id long, point_id long, type int, x double, y double")
    p.write.parquet(str(tmp_path / "in"))
    from pointweave.settings import Settings

    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    q = regrow.regrow(stream, str(tmp_path / "points"), str(tmp_path / "history"), str(tmp_path / "ck"), Settings(p_size=1.0, postpone_intersections=False))
    q.awaitTermination(60)
    h = regrow.current(spark, str(tmp_path / "history"))
    assert h.where("seq = 0").count() == 6 and h.where("seq > 0").count() == 4


def test_svg_shapes(spark):
    text = '<svg><path d="M0,0 L10,0 L10,10 L0,10 Z" fill="#a6ceff" stroke="#000000" stroke-width="1.5"/><path d="M4,4 L6,4 L6,6 L4,6 Z" fill="#ffffff" stroke="#000000"/><path d="M1,1 L1.5,1 L1.5,1.5 Z" fill="#fb9a99" stroke="#000000"/></svg>'
    s = svg.classify_shapes(svg.svg_shapes(spark.createDataFrame([(text,)], "value string")), 0.5, check_holes=True)
    rows = s.orderBy("shape_id").collect()
    assert [(r["role"], r["type"], r["stroke_width"]) for r in rows] == [("region", 7, 1.5), ("hole", 10, None), ("point", 1, None)]
    p = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 5.0), (2, 20.0, 1.0)], "point_id long, x double, y double")
    assert [tuple(r) for r in svg.region_members(s, p).collect()] == [(0, 0)]
    m = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (2, 1), (2, 2)], "shape_id long, point_id long")
    assert [r[0] for r in svg.drop_contained(m).collect()] == [0]


def test_a_hole_counts_for_its_own_region(spark):
    box = lambda i, role, x0, y0, x1, y1: (i, role, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    s = spark.createDataFrame([box(1, "region", 0.0, 0.0, 30.0, 30.0), box(2, "region", 20.0, 0.0, 60.0, 30.0), box(3, "hole", 22.0, 1.0, 26.0, 5.0), box(4, "hole", 2.0, 2.0, 4.0, 4.0)], f"shape_id long, role string, ring {svg.RING}")
    p = spark.createDataFrame([(0, 24.0, 3.0), (1, 3.0, 3.0), (2, 50.0, 9.0), (3, 10.0, 9.0)], "point_id long, x double, y double")
    assert sorted(map(tuple, svg.region_members(s, p).collect())) == [(1, 3), (2, 2)]
    narrow = spark.createDataFrame([box(1, "region", 0.0, 0.0, 23.0, 30.0), box(3, "hole", 22.0, 1.0, 26.0, 5.0)], f"shape_id long, role string, ring {svg.RING}")
    q = spark.createDataFrame([(0, 22.5, 3.0)], "point_id long, x double, y double")
    assert svg.region_members(narrow, q).count() == 1


def test_svg_groups_curves_and_places():
    text = '<svg xmlns="http://www.w3.org/2000/svg"><g fill="#FF0000" transform="translate(10 20)"><g stroke="black" stroke-width="2px"><circle cx="1" cy="2" r="3"/><rect x="0" y="0" width="4" height="2" fill="none" transform="scale(2)"/></g><path style="stroke: #00f" d="m 0 0 h 4 v 4 h -4 z"/></g><path d="M0 0 A 5 5 0 0 1 10 0 Q 5 9 0 0"/><polygon points="0,0 4,0 4,4"/></svg>'
    found = svg.shapes_of(text)
    xy = lambda r: [(round(p["x"], 6), round(p["y"], 6)) for p in r]
    assert [f[1:] for f in found] == [("#ff0000", "black", 2.0), (None, "black", 2.0), ("#ff0000", "#00f", None), (None, None, None), (None, None, None)]
    assert xy(found[0][0])[0] == (14.0, 22.0) and len(found[0][0]) == 64
    assert xy(found[1][0]) == [(10, 20), (18, 20), (18, 24), (10, 24)]
    assert xy(found[2][0]) == [(10, 20), (14, 20), (14, 24), (10, 24)]
    assert all(abs((p["x"] - 5) ** 2 + p["y"] ** 2 - 25) < 1e-9 and p["y"] < 1e-9 for p in found[3][0][:17])
    assert xy(found[4][0]) == [(0, 0), (4, 0), (4, 4)]


def test_parse_svg_modes(spark):
    dot = lambda x, y, c: f'<circle cx="{x}" cy="{y}" r="1" fill="{c}" stroke="#000000"/>'
    red, blue = "#fb9a99", "#a6cee3"
    frame = lambda x0, y0, x1, y1, fill, stroke, w: f'<path d="M{x0},{y0} L{x1},{y0} L{x1},{y1} L{x0},{y1} Z" fill="{fill}" stroke="{stroke}" stroke-width="{w}"/>'
    text = "<svg>" + frame(0, 0, 40, 40, "none", red, 2) + frame(5, 5, 20, 20, "none", red, 2) + dot(10, 10, red) + dot(30, 30, red) + dot(39.8, 20, red) + dot(70, 70, blue) + "</svg>"
    files = spark.createDataFrame([(1, text)], "dataset_id long, value string")
    for mode, want in ((None, [[0], [0, 1, 2], [3]]), ("cluster", [[0, 1, 2], [3]]), ("simple", [[0], [0, 1], [2], [3]])):
        points, patterns = svg.parse_svg(files, 1.0, mode=mode)
        rows = patterns.collect()
        assert sorted(r["point_ids"] for r in rows) == want, mode
        assert points.count() == 4 and not any(r["mixed"] for r in rows)
        assert all((r["ring"] is None) == (mode is None and r["shape_id"] is None) for r in rows)


def test_text_points_of_several_files(spark, tmp_path):
    for name, lines in (("a", ["0 1 2", "", "1 3 4"]), ("b", ["2 5 6"] * 400)):
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        for mode in ("FAILFAST", "PERMISSIVE"):
            read = src.read_points(spark, str(tmp_path), mode)
            assert dict(read.dtypes)["point_id"] == "bigint"
            rows = read.collect()
            by = {n: sorted(r["point_id"] for r in rows if r["dataset"].endswith(f"/{n}.txt")) for n in "ab"}
            assert by == {"a": [0, 2], "b": list(range(400))}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_saving_and_examples(spark, tmp_path):
    p = spark.createDataFrame([(1, 1, 0, 3.0, 4.0), (1, 0, 2, 1.0, 2.5), (2, 0, 1, 5.0, 6.0)], "dataset_id long, point_id long, type int, x double, y double")
    src.save_points(p, str(tmp_path / "p"))
    assert next((tmp_path / "p" / "dataset_id=1").glob("*.txt")).read_text() == "2 1.000 2.500\n0 3.000 4.000\n"
    (tmp_path / "nyc.ipe").write_text(IPE)
    points, s = src.load_example(spark, str(tmp_path), "nyc")
    assert points.count() == 3 and s.cover == 4.87
    each = p.select("dataset_id", F.col("point_id").alias("z"), drawing.ipe_circle(F.col("x"), F.col("y"), F.lit(2.0), F.col("type")).alias("ipe"))
    each = each.unionByName(p.select("dataset_id", (F.col("point_id") + 9).alias("z"), drawing.ipe_text(F.col("x"), F.col("y"), F.lit("a<b")).alias("ipe")))
    drawing.save(drawing.ipe_page(each), str(tmp_path / "d"))
    text = next((tmp_path / "d" / "dataset_id=2").glob("*.txt")).read_text()
    assert "2.000 0 0 2.000 5.000 6.000 e" in text and "a&lt;b" in text
