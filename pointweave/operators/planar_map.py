"""The arrangement of closed polylines as tables: crossings, edges, half-edges with their next ones, faces, origins.

Segments meet in cells of the size of the longer one; each segment is cut at its crossings by a window of its own; around a
node the next half-edge is a neighbour in angular order; faces are the cycles of `next` (see cycles). No table has a group
that grows with a dataset or a ring, but for the segments that meet in one point.

Places are rounded to SNAP decimals and kept as whole numbers of such units (ux, uy, vx, vy), so equal places are equal.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planar import _turns, distance, ring_contains
from ..plans.storage import cut_lineage
from .cycles import cycles, ordered
from .grids import cell, cells_along, within_boxes
from .skeleton import components

SNAP = 6
UNIT = 10.0**-SNAP
#: Sizes of segments that are told apart, each twice as long as the one before; shorter ones count as the shortest.
SIZES = 24
#: A segment of a size is dealt to cells of a quarter of it.
FINER = 2


def _units(v: Column) -> Column:
    return F.round(v / UNIT).cast("long")


def _place(c: str) -> Column:
    return F.col(c) * UNIT


def segments(rings: DataFrame, key: str, ring: str = "ring_id") -> DataFrame:
    """(key, ring_id, k, ix, iy, jx, jy) of each ring's sides that have a length."""
    each = rings.select(key, F.col(ring).alias("ring_id"), F.posexplode(_turns(F.col("ring"))).alias("k", "s"))
    each = each.select(key, "ring_id", "k", F.col("s.p.x").alias("ix"), F.col("s.p.y").alias("iy"), F.col("s.q.x").alias("jx"), F.col("s.q.y").alias("jy"))
    return each.where((F.col("ix") != F.col("jx")) | (F.col("iy") != F.col("jy")))


def crossings(sides: DataFrame, key: str, part: Column | None = None) -> DataFrame:
    """(key, ring1, k1, t1, ring2, k2, t2, x, y): sides of different rings that meet (of different `part`, if given), with
    the fraction of each where they do. Parallel sides don't meet. `sides` should be a written table, as it is read several times.

    A side is dealt to cells along it, for its own size and for each greater size that occurs; a pair meets where the
    longer one's size is, and counts in the cell that holds the meeting point.
    """
    size = F.ceil(F.log2(distance(F.col("ix"), F.col("iy"), F.col("jx"), F.col("jy")))).cast("int")
    sized = sides.withColumn("size", size).withColumn("part", F.col("ring_id") if part is None else part)
    found = sorted(r[0] for r in sized.select("size").distinct().orderBy(F.desc("size")).limit(SIZES).collect())
    if not found:
        found = [0]
    own = F.greatest(F.col("size"), F.lit(found[0]))
    dealt = sized.withColumn("size", own).withColumn("at", F.explode(F.filter(F.array(*map(F.lit, found)), lambda v: v >= F.col("size"))))
    width = F.pow(F.lit(2.0), F.col("at") - FINER)
    dealt = cells_along(dealt, width * 1e-6, width)
    cols = ("ring_id", "part", "k", "ix", "iy", "jx", "jy", "size")
    one = dealt.where("at = size").select(key, "at", "__cx", "__cy", *[F.col(c).alias(f"{c}_a") for c in cols])
    two = dealt.select(key, "at", "__cx", "__cy", *[F.col(c).alias(f"{c}_b") for c in cols])
    once = (F.col("size_b") < F.col("at")) | (F.col("ring_id_a") < F.col("ring_id_b"))
    met = one.join(two, [key, "at", "__cx", "__cy"]).where((F.col("part_a") != F.col("part_b")) & once)
    a, b = ((F.col(f"jx_{s}") - F.col(f"ix_{s}"), F.col(f"jy_{s}") - F.col(f"iy_{s}")) for s in "ab")
    gap = F.col("ix_b") - F.col("ix_a"), F.col("iy_b") - F.col("iy_a")
    met = met.withColumn("den", a[0] * b[1] - a[1] * b[0]).where(F.abs("den") > 1e-12)
    met = met.withColumn("t", (gap[0] * b[1] - gap[1] * b[0]) / F.col("den")).withColumn("u", (gap[0] * a[1] - gap[1] * a[0]) / F.col("den")).where("t >= 0 and t <= 1 and u >= 0 and u <= 1")
    met = met.withColumn("x", F.col("ix_a") + F.col("t") * a[0]).withColumn("y", F.col("iy_a") + F.col("t") * a[1])
    side = F.pow(F.lit(2.0), F.col("at") - FINER)
    met = met.where((cell(F.col("x"), side) == F.col("__cx")) & (cell(F.col("y"), side) == F.col("__cy")))
    first = F.col("ring_id_a") < F.col("ring_id_b")
    pick = lambda p, q, name: F.when(first, F.col(p)).otherwise(F.col(q)).alias(name)
    return met.select(key, *[pick(f"{p}", f"{q}", n) for p, q, n in (("ring_id_a", "ring_id_b", "ring1"), ("k_a", "k_b", "k1"), ("t", "u", "t1"), ("ring_id_b", "ring_id_a", "ring2"), ("k_b", "k_a", "k2"), ("u", "t", "t2"))], "x", "y")


def _twice() -> Column:
    """Twice the area that a half-edge adds to what lies to its left."""
    return _place("ux") * _place("vy") - _place("vx") * _place("uy")


def _loops(border: DataFrame, who: list[str]) -> DataFrame:
    """border (who, h, ux, uy, vx, vy, ...) with loop and place: each half-edge is followed by the one that leaves its end
    next to the right of turning back, of those with equal `who`.
    """
    border = cut_lineage(border)
    leave = border.select(*who, F.col("h").alias("next"), F.col("ux").alias("vx"), F.col("uy").alias("vy"), F.col("vx").alias("wx"), F.col("vy").alias("wy"))
    back = F.atan2(_place("uy") - _place("vy"), _place("ux") - _place("vx"))
    on = F.atan2(_place("wy") - _place("vy"), _place("wx") - _place("vx"))
    turn = F.pmod(back - on, F.lit(6.283185307179586))
    follow = border.join(leave, [*who, "vx", "vy"]).groupBy(*who, "h").agg(F.min_by("next", F.struct(F.when(turn <= 1e-12, 7.0).otherwise(turn), "next")).alias("next"))
    node = lambda c: F.struct(*who, F.col(c).alias("h"))
    walk = cycles(follow.select(node("h").alias("node"), node("next").alias("next"))).select("node.*", F.col("cycle.h").alias("loop"), "place")
    return cut_lineage(border.join(walk, [*who, "h"]))


@dataclass
class PlanarMap:
    """The arrangement of (key, ring_id, ring). Tables are made when they are asked for; each is written once.

    Rings of one dataset may cross in any way; a side along another ring's side, with the same direction, is not cut at
    that ring's corners. Rings without a length have no edges.
    """

    rings: DataFrame
    key: str = "dataset_id"
    ring: str = "ring_id"

    @cached_property
    def sides(self) -> DataFrame:
        return cut_lineage(segments(self.rings, self.key, self.ring))

    @cached_property
    def crossings(self) -> DataFrame:
        return cut_lineage(crossings(self.sides, self.key))

    @property
    def vertices(self) -> DataFrame:
        """(key, ux, uy, rings): the places where rings cross."""
        each = self.crossings.select(self.key, _units(F.col("x")).alias("ux"), _units(F.col("y")).alias("uy"), F.explode(F.array("ring1", "ring2")).alias("r"))
        return each.groupBy(self.key, "ux", "uy").agg(F.array_sort(F.collect_set("r")).alias("rings"))

    @cached_property
    def edges(self) -> DataFrame:
        """(key, e, ux, uy, vx, vy, rings): what lies between neighbouring places of a ring; equal edges of rings are one."""
        key, s = self.key, self.sides
        at = lambda x, y, ring, k, t: (key, F.col(ring).alias("ring_id"), F.col(k).alias("k"), (F.col(t) if isinstance(t, str) else F.lit(t)).alias("t"), F.struct(_units(F.col(x)).alias("x"), _units(F.col(y)).alias("y")).alias("p"))
        stops = s.select(*at("ix", "iy", "ring_id", "k", 0.0)).unionByName(s.select(*at("jx", "jy", "ring_id", "k", 1.0)))
        for n in ("1", "2"):
            stops = stops.unionByName(self.crossings.select(*at("x", "y", "ring" + n, "k" + n, "t" + n)))
        w = Window.partitionBy(key, "ring_id", "k").orderBy("t", "p")
        # A side's own ends come first and last among stops of the same fraction.
        cut = stops.withColumn("q", F.lead("p").over(w)).where("p != q").select(key, "ring_id", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))
        one = cut.groupBy(key, "u", "v").agg(F.array_sort(F.collect_set("ring_id")).alias("rings"))
        return cut_lineage(one.select(key, F.monotonically_increasing_id().alias("e"), F.col("u.x").alias("ux"), F.col("u.y").alias("uy"), F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), "rings"))

    @property
    def halves(self) -> DataFrame:
        """(key, h, ux, uy, vx, vy, rings): both directions of each edge; h and h xor 1 are twins."""
        e = self.edges
        back = e.select(self.key, (F.col("e") * 2 + 1).alias("h"), F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy"), "rings")
        return e.select(self.key, (F.col("e") * 2).alias("h"), "ux", "uy", "vx", "vy", "rings").unionByName(back)

    @property
    def next(self) -> DataFrame:
        """(node, next): from each half-edge the one by which its face goes on, the first to the right of turning back."""
        angle = F.atan2(_place("vy") - _place("uy"), _place("vx") - _place("ux"))
        around = Window.partitionBy(self.key, "ux", "uy").orderBy("angle", "vx", "vy")
        whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.coalesce(F.lag("h").over(around), F.last("h").over(whole))
        return self.halves.withColumn("angle", angle).select(F.col("h").bitwiseXOR(F.lit(1)).alias("node"), before.alias("next"))

    @cached_property
    def half_edges(self) -> DataFrame:
        """halves with the face (its least half-edge) to their left and their place along it."""
        walk = cycles(self.next).select(F.col("node").alias("h"), F.col("cycle").alias("face"), "place")
        return cut_lineage(self.halves.join(walk, "h"))

    @cached_property
    def faces(self) -> DataFrame:
        """(key, face, n_edges, area, px, py, origins): bounded faces, a place in each, and the rings that hold it.

        A face's area is that within its outer line; what lies within without touching it isn't taken off.
        """
        size = distance(_place("ux"), _place("uy"), _place("vx"), _place("vy"))
        h = self.half_edges.withColumn("size", size)
        longest = F.max_by(F.struct("ux", "uy", "vx", "vy", "size"), F.struct("size", "h"))
        each = h.groupBy(self.key, "face").agg(F.count(F.lit(1)).alias("n_edges"), (F.sum(_twice()) / 2).alias("area"), longest.alias("s")).where(F.col("area") > 5e-10)
        # Just left of the middle of the longest edge.
        step = F.least(F.lit(0.01), F.col("s.size") / 100) / F.col("s.size")
        px = (_place("s.ux") + _place("s.vx")) / 2 - (_place("s.vy") - _place("s.uy")) * step
        py = (_place("s.uy") + _place("s.vy")) / 2 + (_place("s.vx") - _place("s.ux")) * step
        each = cut_lineage(each.select(self.key, "face", "n_edges", "area", px.alias("px"), py.alias("py")))
        at = each.select(self.key, "face", F.col("px").alias("x"), F.col("py").alias("y"))
        held = within_boxes(at, self.rings.select(self.key, F.col(self.ring).alias("ring_id"), "ring"), (self.key,)).where(ring_contains(F.col("ring"), F.col("x"), F.col("y")))
        origins = held.groupBy("face").agg(F.array_sort(F.collect_set("ring_id")).alias("origins"))
        none = F.array().cast(origins.schema["origins"].dataType)
        return cut_lineage(each.join(origins, "face", "left").withColumn("origins", F.coalesce("origins", none)))

    def outlines(self) -> DataFrame:
        """(key, face, ring) of the bounded faces, counter-clockwise."""
        own = self.half_edges.join(self.faces.select("face"), "face", "left_semi")
        return ordered(own, [self.key, "face"], "place", F.struct(_place("ux").alias("x"), _place("uy").alias("y")))

    def counts(self) -> DataFrame:
        """(key, n_vertices, n_edges, n_faces) for each key with rings."""
        count = lambda t, name: t.groupBy(self.key).agg(F.count(F.lit(1)).alias(name))
        out = self.rings.select(self.key).distinct()
        for t, name in ((self.vertices, "n_vertices"), (self.edges, "n_edges"), (self.faces, "n_faces")):
            out = out.join(count(t, name), self.key, "left")
        return out.select(self.key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_vertices", "n_edges", "n_faces")])

    @cached_property
    def face_parts(self) -> DataFrame:
        """(face, part): which faces, the outer ones included, hang together by edges."""
        h = self.half_edges.select("h", "face")
        twin = h.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.col("face").alias("j"))
        links = h.join(twin, "h").select(F.col("face").alias("i"), "j").where("i < j").distinct()
        return components(h.select(F.col("face").alias("point_id")).distinct(), links).select(F.col("point_id").alias("face"), F.col("component").alias("part"))

    @cached_property
    def regions(self) -> DataFrame:
        """(face, region): each cycle of half-edges, and the bounded face that lies to their left; null: the plane outside.

        A part that lies in a face and touches none of its edges has an outer cycle, of negative area, that borders on
        this face: its leftmost place is looked up among the faces of other parts, and the smallest that holds it is it.
        """
        outer = self.half_edges.groupBy(self.key, "face").agg((F.sum(_twice()) / 2).alias("area"), F.min(F.struct("ux", "uy")).alias("p")).where(F.col("area") < -5e-10).join(self.face_parts, "face")
        outer = cut_lineage(outer.select(self.key, F.col("face").alias("cycle"), F.col("part").alias("inner"), _place("p.ux").alias("x"), _place("p.uy").alias("y")))
        f = self.faces.join(self.face_parts, "face")
        lines = self.outlines().join(f.select("face", "part", "area"), "face")
        held = within_boxes(outer, lines, (self.key,)).where(F.col("inner") != F.col("part")).where(ring_contains(F.col("ring"), F.col("x"), F.col("y")))
        inside = held.groupBy("cycle").agg(F.min_by("face", F.struct("area", "face")).alias("region"))
        return cut_lineage(self.faces.select("face", F.col("face").alias("region")).unionByName(outer.join(inside, "cycle", "left").select(F.col("cycle").alias("face"), "region")))

    def net_areas(self) -> DataFrame:
        """(key, face, origins, area): bounded faces without the parts that lie in them and touch none of their edges."""
        own = self.half_edges.join(self.regions.where("region is not null"), "face").groupBy(F.col("region").alias("face")).agg((F.sum(_twice()) / 2).alias("area"))
        return self.faces.drop("area").join(own, "face").select(self.key, "face", "origins", "area")

    def borders(self, chosen: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
        """(key, labels, h, loop, place, ux, uy, vx, vy): around the union of some faces (face, labels) for each label, by
        loop: counter-clockwise around it, clockwise around its holes.
        """
        who = [self.key, *labels]
        h = self.half_edges.drop("face", "place", "rings").join(self.half_edges.select("h", "face").join(self.regions, "face").select("h", F.col("region").alias("face")), "h")
        mine = cut_lineage(h.join(chosen.select("face", *labels), "face").drop("face"))
        inner = mine.select(*who, F.col("h").bitwiseXOR(F.lit(1)).alias("h"))
        return _loops(mine.join(inner, [*who, "h"], "left_anti"), who)

    def union_areas(self, chosen: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
        """(key, labels, area) of the union of some faces (face, labels) for each label."""
        own = self.half_edges.join(self.regions.withColumnRenamed("face", "cycle"), F.col("face") == F.col("cycle")).drop("face", "cycle")
        return own.join(chosen.select(F.col("face").alias("region"), *labels), "region").groupBy(self.key, *labels).agg((F.sum(_twice()) / 2).alias("area"))

    @cached_property
    def overlaps(self) -> DataFrame:
        """(key, i, j, face, component): faces that rings i < j both hold; component: the least of those that hang together
        by edges within them.
        """
        a, b = F.explode("origins").alias("i"), F.explode("origins").alias("j")
        held = cut_lineage(self.faces.select(self.key, "face", "origins", a).select(self.key, "face", "i", b).where("i < j"))
        node = F.struct("i", "j", "face")
        h = self.half_edges.select("h", "face")
        twin = h.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.col("face").alias("other"))
        side = h.join(twin, "h").where("face < other").select("face", "other").distinct()
        links = held.join(side, "face").join(held.select(F.col("face").alias("other"), F.col("i").alias("i2"), F.col("j").alias("j2")), "other").where("i = i2 and j = j2")
        found = components(held.select(node.alias("point_id")), links.select(node.alias("i"), F.struct("i", "j", F.col("other").alias("face")).alias("j")))
        at = found.select("point_id.*", F.col("component.face").alias("component"))
        return cut_lineage(held.join(at, ["i", "j", "face"]))

    @cached_property
    def boundaries(self) -> DataFrame:
        """(key, i, j, component, h, on_i, on_j, loop, place, ux, uy, vx, vy): half-edges along the borders of overlaps,
        by loop and place along it; each is on the outline of ring i, of ring j, or of both.

        Where several border edges leave a node, a border goes on by the first to the right of turning back.
        """
        who = [self.key, "i", "j", "component"]
        h = self.overlaps.join(self.half_edges.drop("place"), [self.key, "face"])
        inner = h.select(*who, F.col("h").bitwiseXOR(F.lit(1)).alias("h"))
        border = h.join(inner, [*who, "h"], "left_anti").select(*who, "h", F.array_contains("rings", F.col("i")).alias("on_i"), F.array_contains("rings", F.col("j")).alias("on_j"), "ux", "uy", "vx", "vy")
        return _loops(border, who)

    def boundary_parts(self) -> DataFrame:
        """(key, i, j, component, ring, n_parts, n_edges, length): of each overlap's border the stretches along ring i or j.

        A stretch begins where the edge before it, around the loop, isn't on that ring; a loop all on it is one.
        """
        who = [self.key, "i", "j", "component"]
        loop = Window.partitionBy(*who, "loop", "ring").orderBy("place")
        whole = loop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        each = self.boundaries.select("*", F.explode(F.array(F.struct(F.col("i").alias("ring"), F.col("on_i").alias("on")), F.struct(F.col("j").alias("ring"), F.col("on_j").alias("on")))).alias("r")).select("*", "r.ring", "r.on")
        # Gaps and islands on a cycle: the last edge comes before the first.
        each = each.withColumn("before", F.coalesce(F.lag("on").over(loop), F.last("on").over(whole)))
        length = distance(_place("ux"), _place("uy"), _place("vx"), _place("vy"))
        per = each.groupBy(*who, "loop", "ring").agg(F.sum(F.when(F.col("on") & ~F.col("before"), 1).otherwise(0)).alias("begun"), F.bool_and("on").alias("all"), F.sum(F.when(F.col("on"), 1).otherwise(0)).alias("n_edges"), F.sum(F.when(F.col("on"), length).otherwise(0.0)).alias("length"))
        parts = F.when(F.col("all"), 1).otherwise(F.col("begun"))
        return per.groupBy(*who, "ring").agg(F.sum(parts).alias("n_parts"), F.sum("n_edges").alias("n_edges"), F.sum("length").alias("length"))
