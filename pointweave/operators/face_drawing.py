"""Drawing an arrangement face by face, where no order of whole regions exists: each face has an order of its own.

In a face the rings that hold it lie above each other by pairwise relations. A ring's level is the number of rings it lies
above there; if the relations have no cycle in a face, its levels are 0, 1, ... and the greatest is on top. What is seen of a
face are its layers down to the first that fills all of it. Faces of one top meet in seams, which are drawn in its colour
so that no gap shows; outlines are drawn where their ring is on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut_lineage
from ..sources.drawing import color_of, path_tag
from .planar_map import UNIT, PlanarMap


def face_layers(m: PlanarMap, above: DataFrame, morphed: DataFrame | None = None) -> DataFrame:
    """(key, face, ring_id, level, n, cyclic, visible): the rings that hold each bounded face, from below.

    above: (key, over, under), pairs of rings of which one lies above the other wherever they overlap; of pairs without a
    row the greater ring lies above. In a face whose relations have a cycle, equal levels are ordered by ring, and cyclic is
    true. morphed: (face, ring_id) of rings that don't fill all of a face, so that what is below them is seen.
    """
    held = m.faces.select(m.key, "face", F.size("origins").alias("n"), "origins", F.explode("origins").alias("a")).select(m.key, "face", "n", "a", F.explode("origins").alias("b"))
    rule = above.select(m.key, F.col("over").alias("a"), F.col("under").alias("b"), F.lit(1).alias("wins"))
    other = above.select(m.key, F.col("under").alias("a"), F.col("over").alias("b"), F.lit(0).alias("wins"))
    met = held.join(rule.unionByName(other).distinct(), [m.key, "a", "b"], "left")
    wins = F.when(F.col("a") == F.col("b"), 0).otherwise(F.coalesce("wins", (F.col("a") > F.col("b")).cast("int")))
    level = met.groupBy(m.key, "face", "n", F.col("a").alias("ring_id")).agg(F.sum(wins).alias("wins"))
    face = Window.partitionBy("face")
    ranked = level.withColumn("level", F.row_number().over(face.orderBy("wins", "ring_id")) - 1)
    ranked = ranked.withColumn("cyclic", F.max((F.col("wins") != F.col("level")).cast("int")).over(face) == 1)
    if morphed is None:
        ranked = ranked.withColumn("part", F.lit(False))
    else:
        ranked = ranked.join(morphed.select("face", "ring_id", F.lit(True).alias("part")).distinct(), ["face", "ring_id"], "left").withColumn("part", F.coalesce("part", F.lit(False)))
    ground = F.coalesce(F.max(F.when(~F.col("part"), F.col("level"))).over(face), F.lit(0))
    return cut_lineage(ranked.withColumn("visible", F.col("level") >= ground).select(m.key, "face", "ring_id", "level", "n", "cyclic", "visible"))


def tops(layers: DataFrame) -> DataFrame:
    """(face, top) of faces whose relations have no cycle."""
    return layers.where((F.col("level") == F.col("n") - 1) & ~F.col("cyclic")).select("face", F.col("ring_id").alias("top"))


def seams(m: PlanarMap, layers: DataFrame) -> DataFrame:
    """(key, h, top, ux, uy, vx, vy): one half-edge of each edge between two faces of the same top."""
    at = m.half_edges.join(m.regions, "face").select(m.key, "h", "ux", "uy", "vx", "vy", F.col("region").alias("face")).join(tops(layers), "face")
    twin = at.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.col("top").alias("other"), F.col("face").alias("beyond"))
    return at.join(twin, "h").where("top = other and h < h ^ 1 and face != beyond").select(m.key, "h", "top", "ux", "uy", "vx", "vy")


def strokes(m: PlanarMap, layers: DataFrame) -> DataFrame:
    """(key, h, ring_id, ux, uy, vx, vy): half-edges along a ring's outline, on the side where that ring is on top."""
    at = m.half_edges.join(m.regions, "face").select(m.key, "h", "ux", "uy", "vx", "vy", "rings", F.col("region").alias("face"))
    return at.join(tops(layers), "face").where(F.array_contains("rings", F.col("top"))).select(m.key, "h", F.col("top").alias("ring_id"), "ux", "uy", "vx", "vy")


def elements(m: PlanarMap, layers: DataFrame, types: DataFrame, white: float = 0.7) -> DataFrame:
    """(key, z, svg): seams, then the visible layers of each face from below, then outlines. types: (key, ring_id, type)."""
    line = F.array(*[F.struct((F.col(f"{c}x") * UNIT).alias("x"), (F.col(f"{c}y") * UNIT).alias("y")) for c in "uv"])

    def edge(kind: str, width: float, pale: float):
        from ..sources.drawing import path_data

        return F.concat(F.lit('<path d="'), path_data(line, closed=False), F.lit('" fill="none" stroke="'), color_of(F.col(kind), pale), F.lit(f'" stroke-width="{width!r}"/>'))

    z = lambda part, *by: F.struct(F.lit(part).alias("part"), *[c.cast("long").alias(f"k{i}") for i, c in enumerate(by)])
    zero = F.lit(0)
    seam = seams(m, layers).withColumnRenamed("top", "ring_id").join(types, [m.key, "ring_id"]).select(m.key, z(0, F.col("h"), zero).alias("z"), edge("type", 0.5, white).alias("svg"))
    fill = layers.where("visible").join(m.outlines().drop(m.key), "face").join(types, [m.key, "ring_id"]).select(m.key, z(1, F.col("face"), F.col("level")).alias("z"), path_tag(F.col("ring"), F.col("type"), 0.0, white).alias("svg"))
    stroke = strokes(m, layers).join(types, [m.key, "ring_id"]).select(m.key, z(2, F.col("h"), zero).alias("z"), edge("type", 1.0, 0.0).alias("svg"))
    return seam.unionByName(fill).unionByName(stroke)
