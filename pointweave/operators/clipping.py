"""Boolean combinations of rings by fill rules, on the faces of their arrangement.

Each face has a winding number for the subject rings and one for the clip rings: how often they go around it, counter-
clockwise ones counting up. A rule says which numbers are filled, an operation which faces stay. So any combination is a
filter on one table of faces; its area and its outline come from the half-edges between faces that stay and others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planar import ring_winding
from .cycles import ordered
from .grids import within_boxes
from .planar_map import UNIT, PlanarMap

RULES = {
    "even_odd": lambda w: w % 2 != 0,
    "non_zero": lambda w: w != 0,
    "positive": lambda w: w > 0,
    "negative": lambda w: w < 0,
}
OPERATIONS = {
    "intersection": lambda s, c: s & c,
    "union": lambda s, c: s | c,
    "difference": lambda s, c: s & ~c,
    "xor": lambda s, c: s != c,
}


def windings(m: PlanarMap, clip: Column) -> DataFrame:
    """(key, face, subject, clip, depth): winding numbers of each bounded face, and how many rings hold it by parity.

    clip: on the map's rings, which of them are clip rings; null counts as false.
    """
    rings = m.rings.select(m.key, "ring", F.coalesce(clip, F.lit(False)).alias("__clip"))
    at = m.faces.select(m.key, "face", F.col("px").alias("x"), F.col("py").alias("y"))
    w = ring_winding(F.col("ring"), F.col("x"), F.col("y"))
    held = within_boxes(at, rings, (m.key,)).withColumn("w", w)
    each = held.groupBy("face").agg(F.sum(F.when(F.col("__clip"), 0).otherwise(F.col("w"))).alias("subject"), F.sum(F.when(F.col("__clip"), F.col("w")).otherwise(0)).alias("clip"), F.sum(F.abs("w") % 2).alias("depth"))
    return m.faces.select(m.key, "face").join(each, "face", "left").na.fill(0, ["subject", "clip", "depth"])


def chosen(faces: DataFrame, operation: str, rule: str) -> DataFrame:
    """The faces of windings() that an operation keeps under a rule."""
    return faces.where(OPERATIONS[operation](RULES[rule](F.col("subject")), RULES[rule](F.col("clip"))))


def outlines(m: PlanarMap, faces: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """(key, labels, loop, ring): rings around the union of the faces, holes clockwise."""
    corner = F.struct((F.col("ux") * UNIT).alias("x"), (F.col("uy") * UNIT).alias("y"))
    return ordered(m.borders(faces, labels), [m.key, *labels, "loop"], "place", corner)


def clip_areas(m: PlanarMap, clip: Column) -> DataFrame:
    """(key, operation, rule, area) of every operation under every rule; no row where nothing stays."""
    w = windings(m, clip)
    flags = F.array(*[F.struct(F.lit(o).alias("operation"), F.lit(r).alias("rule"), OPERATIONS[o](RULES[r](F.col("subject")), RULES[r](F.col("clip"))).alias("on")) for o in OPERATIONS for r in RULES])
    kept = w.select("face", F.explode(F.filter(flags, lambda f: f["on"])).alias("f")).select("face", "f.operation", "f.rule")
    return m.union_areas(kept, ("operation", "rule"))


def depth_areas(m: PlanarMap) -> DataFrame:
    """(key, any_area, many_area, odd_area, one_area): covered by any ring, by several, by an odd number, by just one."""
    w = windings(m, F.lit(False)).select("face", "depth")
    a, d = F.col("area"), F.col("depth")
    total = lambda on, name: F.sum(F.when(on, a).otherwise(0.0)).alias(name)
    return m.net_areas().join(w, "face").groupBy(m.key).agg(total(d > 0, "any_area"), total(d > 1, "many_area"), total(d % 2 == 1, "odd_area"), total(d == 1, "one_area"))
