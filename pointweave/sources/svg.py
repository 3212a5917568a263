"""Drawings as tables: the shapes of SVG files, and the points, regions and members that they show."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import booleans
from ..functions.planar import ring_area, ring_contains, ring_distance, ring_holds, segments_cross
from ..operators.grids import boxes_meet, within_boxes
from ..operators.pairs import nearest_color
from ..plans.storage import cut_lineage
from ..settings import PALETTE

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_COMMAND = re.compile(r"([MmLlHhVvCcSsQqTtAaZz])([^MmLlHhVvCcSsQqTtAaZz]*)")
#: How many numbers a command takes, and corners that a curve becomes.
_TAKES = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
_STEPS = 16
RING = "array<struct<x:double,y:double>>"


def _bezier(points: list[complex]) -> list[complex]:
    out = []
    for k in range(1, _STEPS + 1):
        t, row = k / _STEPS, points
        while len(row) > 1:
            row = [a + (b - a) * t for a, b in zip(row, row[1:], strict=False)]
        out.append(row[0])
    return out


def _arc(p: complex, rx: float, ry: float, turn: float, large: bool, sweep: bool, q: complex) -> list[complex]:
    """An elliptic arc from p to q: on the unit circle after undoing the turn and the radii."""
    if not rx or not ry or p == q:
        return [q]
    spin = complex(math.cos(math.radians(turn)), math.sin(math.radians(turn)))
    flat = lambda z: complex((z / spin).real / rx, (z / spin).imag / ry)
    a, b = flat(p), flat(q)
    half = abs(b - a) / 2
    scale = max(half, 1.0)  # radii too small for the ends grow
    a, b, half = a / scale, b / scale, min(half / scale, 1.0)
    side = 1 if large != sweep else -1
    center = (a + b) / 2 + side * 1j * (b - a) / max(abs(b - a), 1e-300) * math.sqrt(max(1 - half * half, 0))
    start, end = (math.atan2((z - center).imag, (z - center).real) for z in (a, b))
    span = (end - start) % (2 * math.pi) if sweep else -((start - end) % (2 * math.pi))
    out = []
    for k in range(1, _STEPS + 1):
        z = (center + complex(math.cos(start + span * k / _STEPS), math.sin(start + span * k / _STEPS))) * scale
        out.append(complex(z.real * rx, z.imag * ry) * spin)
    return [*out[:-1], q]


def path_ring(d: str) -> list[complex]:
    """The corners of a path's first subpath; curves become polylines."""
    out: list[complex] = []
    at, handle, before = 0j, 0j, ""
    for command, rest in _COMMAND.findall(d):
        kind, base = command.upper(), command.islower()
        numbers = [float(x) for x in _NUMBER.findall(rest)]
        if kind == "Z" or (kind == "M" and out):
            break
        for k in range(0, len(numbers) - _TAKES[kind] + 1, _TAKES[kind]):
            v = numbers[k : k + _TAKES[kind]]
            origin = at if base else 0j
            z = lambda i, v=v, origin=origin: complex(v[i], v[i + 1]) + origin
            if kind in "ML" or kind == "T":
                new = [z(0)]
            elif kind in "HV":
                new = [complex(v[0] + origin.real, at.imag) if kind == "H" else complex(at.real, v[0] + origin.imag)]
            elif kind == "A":
                new = _arc(at, abs(v[0]), abs(v[1]), v[2], bool(v[3]), bool(v[4]), complex(v[5], v[6]) + origin)
            mirrored = 2 * at - handle
            if kind in "CS":
                first = z(0) if kind == "C" else mirrored if before in "CS" and before else at
                handle = z(2 if kind == "C" else 0)
                new = _bezier([at, first, handle, z(4 if kind == "C" else 2)])
            elif kind in "QT":
                handle = z(0) if kind == "Q" else mirrored if before in "QT" and before else at
                new = _bezier([at, handle, z(2 if kind == "Q" else 0)])
            at, before = new[-1], kind
            out += new
    return out[:-1] if len(out) > 1 and out[0] == out[-1] else out


def _matrix(text: str) -> np.ndarray:
    m = np.eye(3)
    for name, args in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v = [float(x) for x in _NUMBER.findall(args)]
        one = np.eye(3)
        if name == "matrix":
            one[:2] = np.array(v).reshape(3, 2).T
        elif name == "translate":
            one[0, 2], one[1, 2] = v[0], v[1] if len(v) > 1 else 0.0
        elif name == "scale":
            one[0, 0], one[1, 1] = v[0], v[1] if len(v) > 1 else v[0]
        elif name == "rotate":
            c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            p = np.array(v[1:3] if len(v) > 2 else [0.0, 0.0])
            one[:2, :2] = [[c, -s], [s, c]]
            one[:2, 2] = p - one[:2, :2] @ p
        m = m @ one
    return m


def _outline(tag: str, a: dict) -> list[complex]:
    n = lambda k: float(_NUMBER.search(a.get(k, "0")).group())
    if tag == "path":
        return path_ring(a.get("d", ""))
    if tag in ("polygon", "polyline"):
        v = [float(x) for x in _NUMBER.findall(a.get("points", ""))]
        return [complex(x, y) for x, y in zip(v[::2], v[1::2], strict=False)]
    if tag == "rect":
        x, y, w, h = n("x"), n("y"), n("width"), n("height")
        return [complex(x, y), complex(x + w, y), complex(x + w, y + h), complex(x, y + h)]
    if tag in ("circle", "ellipse"):
        rx, ry = (n("r"), n("r")) if tag == "circle" else (n("rx"), n("ry"))
        turn = [2 * math.pi * k / (4 * _STEPS) for k in range(4 * _STEPS)]
        return [complex(n("cx") + rx * math.cos(t), n("cy") + ry * math.sin(t)) for t in turn]
    return []


def shapes_of(svg: str) -> list[tuple]:
    """(ring, fill, stroke, stroke width) of a document's shapes in drawing order; groups hand down style and place."""
    out: list[tuple] = []
    names = ("fill", "stroke", "stroke-width")

    def visit(node: ET.Element, style: dict, m: np.ndarray) -> None:
        a = dict(node.attrib)
        a.update(part.split(":", 1) for part in (p.strip() for p in a.get("style", "").split(";")) if ":" in part)
        style = style | {k: a[k].strip() for k in names if k in a}
        m = m @ _matrix(a.get("transform", ""))
        line = _outline(node.tag.rpartition("}")[2], a)
        if line:
            p = np.array([[z.real, z.imag, 1.0] for z in line]) @ m.T
            paint = lambda k: None if style.get(k, "none") == "none" else style[k].lower()
            width = _NUMBER.search(style.get("stroke-width", ""))
            out.append(([{"x": float(x), "y": float(y)} for x, y, _ in p], paint("fill"), paint("stroke"), float(width.group()) if width else None))
        for child in node:
            visit(child, style, m)

    visit(ET.fromstring(svg), {}, np.eye(3))
    return out


def svg_shapes(files: DataFrame, content: str = "value", key: str | None = None) -> DataFrame:
    """(key, shape_id, ring, fill, stroke, stroke_width, area, box_area), a row for each shape of each document."""
    keys = [key] if key else []
    kind = f"{key} {files.schema[key].dataType.simpleString()}, " if key else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*keys, "shape_id", "ring", "fill", "stroke", "stroke_width"]
        for pdf in batches:
            yield pd.DataFrame([(*[r[k] for k in keys], i, *s) for r in pdf.to_dict("records") for i, s in enumerate(shapes_of(r[content]))], columns=columns)

    found = files.select(*keys, content).mapInPandas(run, f"{kind}shape_id long, ring {RING}, fill string, stroke string, stroke_width double")
    span = lambda axis: F.array_max(F.transform("ring", lambda p: p[axis])) - F.array_min(F.transform("ring", lambda p: p[axis]))
    return found.withColumn("area", F.abs(ring_area(F.col("ring")))).withColumn("box_area", span("x") * span("y"))


def classify_shapes(shapes: DataFrame, pt_size: float, palette: list[tuple[float, float, float]] = PALETTE, check_holes: bool = False, mode: str | None = None) -> DataFrame:
    """Add `role` (point, hole or region) and `type`, the nearest palette colour's.

    A point is a small box, filled and stroked; in mode "cluster" a shape of more than pt_size in area with a fill and a
    black stroke. A hole is a white shape, if asked for.
    """
    part = lambda i: F.conv(F.substring("fill", 2 + 2 * i, 2), 16, 10).cast("double") / 255
    rgb = shapes.withColumn("r", part(0)).withColumn("g", part(1)).withColumn("b", part(2))
    black = F.col("stroke").isin("#000000", "#000", "black")
    if mode == "cluster":
        point = (F.col("area") > pt_size) & black & F.col("fill").isNotNull()
    else:
        point = (F.col("box_area") < 5 * pt_size * pt_size) & F.col("fill").isNotNull() & F.col("stroke").isNotNull()
    white = F.lit(check_holes) & F.col("fill").isin("#ffffff", "#fff", "white") & (F.col("area") > 1e-6)
    role = F.when(F.coalesce(point, F.lit(False)), "point").when(F.coalesce(white, F.lit(False)), "hole").otherwise("region")
    return nearest_color(rgb, palette).withColumn("role", role).drop("r", "g", "b")


def _wider(ring: pd.Series, by: pd.Series) -> pd.Series:
    """The outer ring of a region and all within `by` of it."""
    out = []
    for r, b in zip(ring, by, strict=True):
        p = np.array([[c["x"], c["y"]] for c in r])
        rings = booleans.buffer([p], float(b)) if len(p) > 2 and b and b > 0 else [p]
        out.append([{"x": float(x), "y": float(y)} for x, y in max(rings, key=lambda q: abs(booleans.rings_area([q])), default=p)])
    return pd.Series(out)


def rings_meet(one, two):
    """Do two rings overlap: does one hold a corner of the other, or do sides cross?"""
    sides = lambda r: F.arrays_zip(r.alias("p"), F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)).alias("q"))
    holds = lambda a, b: F.exists(b, lambda c: ring_contains(a, c["x"], c["y"]))
    cross = F.exists(sides(one), lambda e: F.exists(sides(two), lambda f: segments_cross(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"], f["p"]["x"], f["p"]["y"], f["q"]["x"], f["q"]["y"], inner=0.0)))
    return holds(one, two) | holds(two, one) | cross


def drop_contained(members: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Regions whose points are not all in another region (of equal ones the first stays): keys, shape_id."""
    by = [*keys, "shape_id"]
    size = members.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    other = members.select(*keys, "point_id", F.col("shape_id").alias("other"))
    shared = members.join(other, [*keys, "point_id"]).where("shape_id != other").groupBy(*by, "other").agg(F.count(F.lit(1)).alias("k"))
    sizes = size.select(*keys, F.col("shape_id").alias("other"), F.col("n").alias("m"))
    inside = shared.join(size, by).join(sizes, [*keys, "other"]).where("k = n and (m > n or other < shape_id)")
    return size.select(*by).join(inside.select(*by), by, "left_anti")


def region_members(regions: DataFrame, points: DataFrame, keys: tuple[str, ...] = (), overlap: bool = False, held: DataFrame | None = None) -> DataFrame:
    """(keys, shape_id, point_id): points within each region but not in a hole that lies in that region (with
    overlap=True: that overlaps it). A region that would lose all its points keeps them. What lies on an outline is not
    within it. held: the points (keys, role, shape_id, point_id) within all regions and holes, where they are known.
    """
    by = list(keys)
    parts = regions.select(*by, F.col("shape_id"), "role", "ring")
    if held is None:
        held = within_boxes(points.select(*by, "point_id", "x", "y"), parts, keys).where(ring_holds(F.col("ring"), F.col("x"), F.col("y")))
    pick = lambda role, name, ring: parts.where(F.col("role") == role).select(*by, F.col("shape_id").alias(name), F.col("ring").alias(ring))
    inside = lambda role, name: held.where(F.col("role") == role).select(*by, F.col("shape_id").alias(name), "point_id")
    region, hole = pick("region", "shape_id", "ring"), pick("hole", "hole_id", "hole")
    if overlap:
        owned = boxes_meet(region, hole.withColumnRenamed("hole", "other"), tuple(by)).where(rings_meet(F.col("ring"), F.col("other"))).select(*by, "shape_id", "hole_id")
    else:
        corner = hole.select("*", F.get("hole", F.lit(0))["x"].alias("x"), F.get("hole", F.lit(0))["y"].alias("y"))
        owned = within_boxes(corner, region, tuple(by)).where(F.forall("hole", lambda c: ring_holds(F.col("ring"), c["x"], c["y"]))).select(*by, "shape_id", "hole_id")
    gone = inside("hole", "hole_id").join(owned, [*by, "hole_id"]).select(*by, "shape_id", "point_id", F.lit(True).alias("gone")).distinct()
    every = inside("region", "shape_id").join(gone, [*by, "shape_id", "point_id"], "left")
    left = F.sum(F.when(F.col("gone").isNull(), 1).otherwise(0)).over(Window.partitionBy(*by, "shape_id"))
    return every.withColumn("left", left).where("gone is null or left = 0").select(*by, "shape_id", "point_id")


def parse_svg(files: DataFrame, pt_size: float, palette: list[tuple[float, float, float]] = PALETTE, mode: str | None = None, check_holes: bool = False, content: str = "value", key: str = "dataset_id") -> tuple[DataFrame, DataFrame]:
    """(points, patterns) of drawings: (key, point_id, type, x, y) and (key, shape_id, ring, point_ids, mixed).

    mode "cluster": regions are drawn as strokes in their points' colours, reach half a stroke farther, hold points
    that are not at their very edge, and regions whose points all are in another one or in a hole are left out; "simple":
    points nearer than half a point's size to the outline don't count. Points of no region become discs of half the
    widest stroke ("cluster") or three points' sizes ("simple") with shape_id null; otherwise their ring is null.
    `mixed` says that a region has points of several types.
    """
    s = cut_lineage(classify_shapes(svg_shapes(files, content, key), pt_size, palette, check_holes, mode))  # files are read once
    mid = lambda axis: (F.array_max(F.transform("ring", lambda p: p[axis])) + F.array_min(F.transform("ring", lambda p: p[axis]))) / 2
    dots = s.where("role = 'point'")
    number = F.row_number().over(Window.partitionBy(key).orderBy("shape_id")) - 1
    points = dots.select(key, number.cast("long").alias("point_id"), "type", mid("x").alias("x"), mid("y").alias("y"))
    marks = s.where("role != 'point'").where(F.size("ring") > 1)
    if mode == "cluster":
        marks = marks.join(dots.select(key, F.col("fill").alias("stroke")).distinct(), [key, "stroke"], "left_semi")
        marks = marks.withColumn("ring", F.when(F.col("role") == "region", pandas_udf(_wider, RING)("ring", F.coalesce("stroke_width", F.lit(0.0)) / 2)).otherwise(F.col("ring")))
    held = within_boxes(points.select(key, "point_id", "x", "y"), marks.select(key, "shape_id", "role", "ring", "stroke_width"), (key,)).where(ring_holds(F.col("ring"), F.col("x"), F.col("y")))
    gap = ring_distance(F.col("ring"), F.col("x"), F.col("y"))
    deep = F.lit(True)
    if mode == "cluster":
        deep = gap > F.coalesce("stroke_width", F.lit(0.0)) / 4 - 1e-6
    elif mode == "simple":
        deep = gap >= pt_size / 2
    held = cut_lineage(held.select(key, "shape_id", "role", "point_id", deep.alias("deep")))  # rings are searched once
    some = held.where("deep").select(key, "shape_id", "point_id")
    kept = marks.join(some.select(key, "shape_id").distinct(), [key, "shape_id"], "left_semi")
    members = some.join(region_members(kept, points, (key,), mode == "cluster", held), [key, "shape_id", "point_id"], "left_semi")
    if mode == "cluster":
        both = some.join(kept.select(key, "shape_id"), [key, "shape_id"])
        members = members.join(drop_contained(both, (key,)), [key, "shape_id"], "left_semi")
    typed = members.join(points.select(key, "point_id", "type"), [key, "point_id"])
    own = typed.groupBy(key, "shape_id").agg(F.array_sort(F.collect_list("point_id")).alias("point_ids"), (F.count_distinct("type") > 1).alias("mixed"))
    patterns = kept.where("role = 'region'").select(key, "shape_id", "ring").join(own, [key, "shape_id"])
    stroke = kept.groupBy(key).agg(F.max("stroke_width").alias("w"))
    alone = points.join(members.select(key, "point_id").distinct(), [key, "point_id"], "left_anti").join(stroke, key, "left")
    r = F.coalesce("w", F.lit(0.0)) / 2 if mode == "cluster" else F.lit(3.0 * pt_size)
    turn = F.transform(F.sequence(F.lit(0), F.lit(4 * _STEPS - 1)), lambda k: F.struct((F.col("x") + r * F.cos(k * (math.pi / 2 / _STEPS))).alias("x"), (F.col("y") + r * F.sin(k * (math.pi / 2 / _STEPS))).alias("y")))
    ring = turn if mode else F.lit(None).cast(RING)
    alone = alone.select(key, F.lit(None).cast("long").alias("shape_id"), ring.alias("ring"), F.array("point_id").alias("point_ids"), F.lit(False).alias("mixed"))
    return points, patterns.unionByName(alone)
