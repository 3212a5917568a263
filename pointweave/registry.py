"""Queries by name, and the SQL that gives the same rows. Measures are rounded to six decimals."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.planar import affine, bisector, cover_radius_triangle, directed_angle, distance, fit, orientation, polarity, ring_area, ring_distance, round_half_up, side_of, turn_from
from .operators import banks, fields, hulls, pairs, sets, skeleton
from .settings import PALETTE
from .sources import drawing
from .sources import points as src

THETA = repr(skeleton.angle_limit())
PTS = "pts AS (SELECT vec_id AS point_id, label AS type, 1000 * CAST(embedding[1] AS DOUBLE) AS x, 1000 * CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
DS = PTS + ", ds AS (SELECT point_id % 10 AS dataset_id, * FROM pts)"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    """Rounded; -0.0 is 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


@query(f"WITH {PTS} SELECT point_id, type, x, y FROM pts")
def points_scan(spark: SparkSession, sf: str) -> DataFrame:
    return src.pts(spark, sf)


def _sql_decimal(v: str) -> str:
    k = f"CAST(floor({v} * 1000 + 0.5) AS BIGINT)"
    return f"(CASE WHEN {k} < 0 THEN '-' ELSE '' END || CAST(abs({k}) // 1000 AS VARCHAR) || '.' || lpad(CAST(abs({k}) % 1000 AS VARCHAR), 3, '0'))"


@query(f"WITH {PTS} SELECT point_id, CAST(type AS VARCHAR) || ' ' || {_sql_decimal('x')} || ' ' || {_sql_decimal('y')} AS line FROM pts")
def points_format(spark: SparkSession, sf: str) -> DataFrame:
    return src.format_points(src.pts(spark, sf))


@query(f"WITH {PTS} SELECT point_id, type, floor(x * 1000 + 0.5) / 1000 AS x, floor(y * 1000 + 0.5) / 1000 AS y FROM pts")
def points_parse(spark: SparkSession, sf: str) -> DataFrame:
    return src.parse_points(src.format_points(src.pts(spark, sf)))


@query("""WITH m AS (SELECT c_custkey AS point_id, CASE c_nationkey % 4 WHEN 0 THEN 'CB light red' WHEN 1 THEN 'CART 9' ELSE c_mktsegment END AS fill FROM customer),
f AS (SELECT fill, min(point_id) AS first FROM m WHERE fill NOT IN ('CB light red', 'CART 9') GROUP BY fill), n AS (SELECT fill, row_number() OVER (ORDER BY first) + 6 AS t FROM f)
SELECT point_id, m.fill, CAST(CASE m.fill WHEN 'CB light red' THEN 1 WHEN 'CART 9' THEN 8 ELSE t END AS INTEGER) AS type FROM m LEFT JOIN n ON m.fill = n.fill""")
def category_map(spark: SparkSession, sf: str) -> DataFrame:
    c = src.table(spark, sf, "customer")
    fill = F.when(F.col("c_nationkey") % 4 == 0, "CB light red").when(F.col("c_nationkey") % 4 == 1, "CART 9").otherwise(F.col("c_mktsegment"))
    return src.category_types(c.select(F.col("c_custkey").alias("point_id"), fill.alias("fill")))


@query(f"WITH {PTS} SELECT point_id, type, round(0.5 * x - 1.5 * y + 10, 6) + 0.0 AS x, round(2 * x + 0.25 * y - 3, 6) + 0.0 AS y FROM pts")
def affine_transform(spark: SparkSession, sf: str) -> DataFrame:
    x, y = affine(F.col("x"), F.col("y"), (0.5, 2.0, -1.5, 0.25, 10.0, -3.0))
    return src.pts(spark, sf).select("point_id", "type", r6(x).alias("x"), r6(y).alias("y"))


@query("SELECT event_type AS type, min(value) AS x0, max(value) AS x1, min(hour(ts)) * 1.0::DOUBLE AS y0, max(hour(ts)) * 1.0::DOUBLE AS y1, count(*) AS n FROM events GROUP BY 1")
def bounds_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return hulls.spread(src.event_pts(spark, sf), "type")


@query(f"""WITH {PTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts), s AS (SELECT *, least(760 / (x1 - x0), 760 / (y1 - y0)) AS k FROM b)
SELECT point_id, round((x - (x0 + x1) / 2) * k + 400, 6) + 0.0 AS x, round((y - (y0 + y1) / 2) * k + 400, 6) + 0.0 AS y FROM pts, s""")
def fit_to_box(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled into an 800 x 800 box with margin 20, centre to centre."""
    p = src.pts(spark, sf)
    b = p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    s = p.join(F.broadcast(b))  # one row
    k = F.least(F.try_divide(F.lit(760.0), F.col("x1") - F.col("x0")), F.try_divide(F.lit(760.0), F.col("y1") - F.col("y0")))
    return s.select("point_id", r6((F.col("x") - (F.col("x0") + F.col("x1")) / 2) * k + 400).alias("x"), r6((F.col("y") - (F.col("y0") + F.col("y1")) / 2) * k + 400).alias("y"))


@query(f"WITH {PTS} SELECT point_id, type, x, 800 - y AS y FROM pts")
def y_flip(spark: SparkSession, sf: str) -> DataFrame:
    return src.pts(spark, sf).select("point_id", "type", "x", (800 - F.col("y")).alias("y"))


@query(f"""WITH {PTS} SELECT CASE WHEN point_id = 3 THEN 1.5 ELSE x END AS x, CASE WHEN point_id = 3 THEN 2.251 ELSE y END AS y, point_id, type FROM pts WHERE point_id <> 5
UNION ALL SELECT 1.0, 2.0, (SELECT max(point_id) + 1 FROM pts WHERE point_id <> 5), 0""")
def edited_points(spark: SparkSession, sf: str) -> DataFrame:
    """One point moved, one removed, one placed."""
    p = src.remove(src.move(src.pts(spark, sf), 3, 1.5, 2.2505), 5)
    new = spark.createDataFrame([(0, 0, 1.0, 2.0)], "point_id long, type int, x double, y double")
    return src.place(p, new.select(*p.columns)).select("x", "y", "point_id", "type")


_ANGLE = "acos(greatest(-1.0, least(1.0, ((x1 - x) * (x2 - x1) + (y1 - y) * (y2 - y1)) / (sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))))"
TURNS = f"""{DS}, w AS (SELECT dataset_id, type, point_id, x, y, lead(x) OVER o AS x1, lead(y) OVER o AS y1, lead(x, 2) OVER o AS x2, lead(y, 2) OVER o AS y2, row_number() OVER o - 1 AS k FROM ds WINDOW o AS (PARTITION BY dataset_id, type ORDER BY point_id)),
c AS (SELECT *, (x1 - x) * (y2 - y) - (y1 - y) * (x2 - x) AS d FROM w WHERE x2 IS NOT NULL),
t AS (SELECT dataset_id, type, point_id, k, CASE WHEN abs(d) <= 1e-9 THEN 'STRAIGHT' WHEN d > 0 THEN 'LEFT' ELSE 'RIGHT' END AS orientation, {_ANGLE} AS angle FROM c)"""


@query(f"WITH {TURNS} SELECT dataset_id, type, point_id, k, orientation, round(angle, 6) AS angle FROM t")
def orientation_triples(spark: SparkSession, sf: str) -> DataFrame:
    return banks.turns(src.pts_ds(spark, sf)).withColumn("angle", r6("angle"))


@query(f"WITH {PTS} SELECT a.point_id AS i, b.point_id AS j, round(atan2(-(a.x * b.y - a.y * b.x), -(a.x * b.x + a.y * b.y)) + pi(), 6) AS angle FROM pts a JOIN pts b ON b.point_id = a.point_id + 1")
def directed_angles(spark: SparkSession, sf: str) -> DataFrame:
    p = src.pts(spark, sf)
    q = p.select((F.col("point_id") - 1).alias("i"), F.col("point_id").alias("j"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return p.join(q, F.col("point_id") == F.col("i")).select("i", "j", r6(directed_angle(F.col("x"), F.col("y"), F.col("qx"), F.col("qy"))).alias("angle"))


@query(f"WITH {PTS}, c AS (SELECT a.point_id AS i, b.point_id AS j, a.x, a.y, b.x AS bx, b.y AS qy, sqrt(a.x * a.x + a.y * a.y) AS n, sqrt(b.x * b.x + b.y * b.y) AS m FROM pts a JOIN pts b ON b.point_id = a.point_id + 1), u AS (SELECT *, x / n + bx / m AS ux, y / n + qy / m AS uy FROM c) SELECT i, j, CASE WHEN abs(x - bx) <= 1e-9 THEN 'STRAIGHT' WHEN x < bx THEN 'LEFT' ELSE 'RIGHT' END AS side, CASE WHEN x * qy - y * bx < -1e-9 THEN 'CCW_POSITIVE_Y' ELSE 'CW_NEGATIVE_Y' END AS polarity, round(ux / sqrt(ux * ux + uy * uy), 6) + 0.0 AS mx, round(uy / sqrt(ux * ux + uy * uy), 6) + 0.0 AS my FROM u")
def directions(spark: SparkSession, sf: str) -> DataFrame:
    """Of each point and the next: which is further left, the turn's polarity at the origin, and their bisector."""
    p = src.pts(spark, sf)
    q = p.select((F.col("point_id") - 1).alias("i"), F.col("point_id").alias("j"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    x, y, qx, qy = (F.col(c) for c in ("x", "y", "qx", "qy"))
    mx, my = bisector(x, y, qx, qy)
    return p.join(q, F.col("point_id") == F.col("i")).select("i", "j", side_of(x, qx).alias("side"), polarity(orientation(x * qy - y * qx)).alias("polarity"), r6(mx).alias("mx"), r6(my).alias("my"))


@query(f"WITH {DS}, c AS (SELECT dataset_id, avg(x) AS cx, avg(y) AS cy FROM ds GROUP BY 1), t AS (SELECT ds.dataset_id, point_id, degrees(atan2(y - cy, x - cx)) - 90 AS t FROM ds JOIN c ON c.dataset_id = ds.dataset_id) SELECT dataset_id, point_id, row_number() OVER (PARTITION BY dataset_id ORDER BY t - 360 * floor(t / 360)) AS right_rank, row_number() OVER (PARTITION BY dataset_id ORDER BY t - 360 * floor(t / 360) DESC) AS left_rank FROM t")
def angular_order(spark: SparkSession, sf: str) -> DataFrame:
    """The order of each dataset's points around their centroid from 90 degrees on, both ways."""
    p = src.pts_ds(spark, sf)
    c = p.groupBy("dataset_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    t = p.join(c, "dataset_id").select("dataset_id", "point_id", turn_from(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), 90.0).alias("t"))
    w = Window.partitionBy("dataset_id")
    return t.select("dataset_id", "point_id", F.row_number().over(w.orderBy("t")).cast("long").alias("right_rank"), F.row_number().over(w.orderBy(F.desc("t"))).cast("long").alias("left_rank"))


@query(f"WITH {DS}, b AS (SELECT dataset_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ds GROUP BY 1), k AS (SELECT *, greatest(760 / (x1 - x0), 500 / (y1 - y0)) AS k FROM b) SELECT ds.dataset_id, point_id, round(k * x + 400 - x0 - k * (x1 - x0) / 2, 6) + 0.0 AS x, round(k * y + 270 - y0 - k * (y1 - y0) / 2, 6) + 0.0 AS y FROM ds JOIN k ON k.dataset_id = ds.dataset_id")
def fit_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Each dataset's points mapped so that their box covers a fixed one."""
    p = src.pts_ds(spark, sf)
    b = p.groupBy("dataset_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    m = fit(tuple(F.lit(v) for v in (20.0, 20.0, 780.0, 520.0)), tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    x, y = affine(F.col("x"), F.col("y"), m)
    return p.join(b, "dataset_id").select("dataset_id", "point_id", r6(x).alias("x"), r6(y).alias("y"))


@query(f"""WITH {DS}, h AS (SELECT dataset_id, type, sqrt(power(x - lead(x) OVER o, 2) + power(y - lead(y) OVER o, 2)) AS hop FROM ds WINDOW o AS (PARTITION BY dataset_id, type ORDER BY point_id))
SELECT dataset_id, type, round(coalesce(max(hop), 0) / 2, 6) AS cover_radius, count(*) AS n_points FROM h GROUP BY 1, 2""")
def bank_cover_radius(spark: SparkSession, sf: str) -> DataFrame:
    return banks.cover_radius(src.pts_ds(spark, sf)).withColumn("cover_radius", r6("cover_radius"))


BENDS = f"""{TURNS}, b AS (SELECT *, lag(orientation) OVER (PARTITION BY dataset_id, type ORDER BY k) AS before FROM t),
s AS (SELECT *, sum(CASE WHEN before = CASE orientation WHEN 'LEFT' THEN 'RIGHT' WHEN 'RIGHT' THEN 'LEFT' ELSE 'STRAIGHT' END THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id, type ORDER BY k) AS bend FROM b),
g AS (SELECT dataset_id, type, CAST(bend AS BIGINT) AS bend, arg_min(orientation, k) AS orientation, max(angle) AS max_angle, sum(angle) AS total_angle, min(k) AS start_index, count(*) AS n_turns FROM s GROUP BY 1, 2, 3)"""


@query(f"WITH {BENDS} SELECT dataset_id, type, bend, orientation, round(max_angle, 6) AS max_angle, round(total_angle, 6) AS total_angle, start_index, n_turns FROM g")
def bank_bends(spark: SparkSession, sf: str) -> DataFrame:
    return banks.bends(src.pts_ds(spark, sf)).withColumn("max_angle", r6("max_angle")).withColumn("total_angle", r6("total_angle"))


@query(f"""WITH {BENDS}, v AS (SELECT dataset_id, type, count(*) AS n, max(max_angle) AS m, sum(total_angle) AS t FROM g GROUP BY 1, 2)
SELECT k.dataset_id, k.type, coalesce(n, 0) AS n_bends, coalesce(n, 0) <= 2 AND coalesce(m, 0) <= radians(170) AND coalesce(t, 0) <= radians(720) AS is_valid FROM (SELECT DISTINCT dataset_id, type FROM ds) k LEFT JOIN v ON k.dataset_id = v.dataset_id AND k.type = v.type""")
def bank_valid(spark: SparkSession, sf: str) -> DataFrame:
    return banks.valid(src.pts_ds(spark, sf), max_turning=170.0, max_bend=720.0)


PAIRS = f"{PTS}, pairs AS (SELECT a.type, a.point_id AS i, b.point_id AS j, a.x AS ix, a.y AS iy, b.x AS jx, b.y AS jy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pts a JOIN pts b ON a.type = b.type AND a.point_id < b.point_id)"
RADIUS, CLEAR = 96.0, 0.6
_SEG = "sqrt(power(r.x - (p.ix + greatest(0, least(1, coalesce(((r.x - p.ix) * (p.jx - p.ix) + (r.y - p.iy) * (p.jy - p.iy)) / nullif(power(p.jx - p.ix, 2) + power(p.jy - p.iy, 2), 0), 0))) * (p.jx - p.ix)), 2) + power(r.y - (p.iy + greatest(0, least(1, coalesce(((r.x - p.ix) * (p.jx - p.ix) + (r.y - p.iy) * (p.jy - p.iy)) / nullif(power(p.jx - p.ix, 2) + power(p.jy - p.iy, 2), 0), 0))) * (p.jy - p.iy)), 2))"
_OTHER = "NOT (r.type = p.type AND ((r.x = p.ix AND r.y = p.iy) OR (r.x = p.jx AND r.y = p.jy)))"


@query(f"WITH {PAIRS} SELECT type, i, j, round(d / 2, 6) AS time FROM pairs WHERE d <= {RADIUS}")
def matching_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.near_pairs(src.pts(spark, sf), RADIUS).select("type", "i", "j", r6(F.col("d") / 2).alias("time"))


@query(f"WITH {PAIRS} SELECT type, i, j, round(d / 2, 6) AS time FROM pairs p WHERE d <= {RADIUS} AND NOT EXISTS (SELECT 1 FROM pts r WHERE {_OTHER} AND {_SEG} < {CLEAR * 10})")
def matching_clear(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.clear_near_pairs(src.pts(spark, sf), RADIUS, CLEAR * 10).select("type", "i", "j", r6(F.col("d") / 2).alias("time"))


_SEES = "acos(greatest(-1.0, least(1.0, ((p.ix - r.x) * (p.jx - r.x) + (p.iy - r.y) * (p.jy - r.y)) / (sqrt(power(p.ix - r.x, 2) + power(p.iy - r.y, 2)) * sqrt(power(p.jx - r.x, 2) + power(p.jy - r.y, 2))))))"
SKELETON = f"{PAIRS}, sk AS (SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pts r WHERE {_OTHER} AND (p.ix - r.x) * (p.jx - r.x) + (p.iy - r.y) * (p.jy - r.y) <= 0 AND {_SEES} > {THETA}))"


@query(f"WITH {SKELETON} SELECT type, i, j, round(d, 6) AS length FROM sk")
def beta_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return skeleton.beta_skeleton(src.pts(spark, sf)).select("type", "i", "j", r6("length").alias("length"))


@query(f"WITH {SKELETON} SELECT type, count(*) AS n_edges, round(sum(d), 6) AS total_length, round(max(d), 6) AS longest FROM sk GROUP BY type")
def skeleton_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = skeleton.beta_skeleton(src.pts(spark, sf))
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), r6(F.sum("length")).alias("total_length"), r6(F.max("length")).alias("longest"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return skeleton_summary(spark, sf)


_T = "((c.ix - a.ix) * (c.jy - c.iy) - (c.iy - a.iy) * (c.jx - c.ix)) / nullif((a.jx - a.ix) * (c.jy - c.iy) - (a.jy - a.iy) * (c.jx - c.ix), 0)"
_U = "((c.ix - a.ix) * (a.jy - a.iy) - (c.iy - a.iy) * (a.jx - a.ix)) / nullif((a.jx - a.ix) * (c.jy - c.iy) - (a.jy - a.iy) * (c.jx - c.ix), 0)"
CROSS = f"{SKELETON}, cr AS (SELECT a.i AS i1, a.j AS j1, c.i AS i2, c.j AS j2, a.type AS type1, c.type AS type2 FROM sk a JOIN sk c ON (a.i < c.i OR (a.i = c.i AND a.j < c.j)) WHERE {_T} > 0.01 AND {_T} < 0.99 AND {_U} > 0.01 AND {_U} < 0.99)"


@query(f"WITH {CROSS} SELECT * FROM cr")
def skeleton_crossings(spark: SparkSession, sf: str) -> DataFrame:
    return skeleton.crossings(skeleton.beta_skeleton(src.pts(spark, sf)))


@query(f"WITH {CROSS}, m AS (SELECT i1 AS i, j1 AS j FROM cr UNION ALL SELECT i2, j2 FROM cr), n AS (SELECT i, j, count(*) AS n_crossings FROM m GROUP BY 1, 2) SELECT i, j, n_crossings FROM n ORDER BY n_crossings DESC, i, j LIMIT 20")
def most_crossed_top20(spark: SparkSession, sf: str) -> DataFrame:
    c = skeleton.crossings(skeleton.beta_skeleton(src.pts(spark, sf)))
    ends = c.select(F.col("i1").alias("i"), F.col("j1").alias("j")).unionByName(c.select(F.col("i2").alias("i"), F.col("j2").alias("j")))
    return ends.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n_crossings")).orderBy(F.desc("n_crossings"), "i", "j").limit(20)


@query(f"""WITH RECURSIVE {SKELETON}, e AS (SELECT i AS a, j AS b FROM sk UNION ALL SELECT j, i FROM sk),
walk AS (SELECT point_id AS n, point_id AS c FROM pts UNION SELECT e.b, walk.c FROM walk JOIN e ON walk.n = e.a WHERE e.b > walk.c) SELECT n AS point_id, min(c) AS component FROM walk GROUP BY n""")
def skeleton_components(spark: SparkSession, sf: str) -> DataFrame:
    p = src.pts(spark, sf)
    return skeleton.components(p, skeleton.beta_skeleton(p))


_HULL = "(SELECT 1 FROM pts r WHERE r.type = a.type AND ((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) > 1e-9 OR (abs((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x)) <= 1e-9 AND r.point_id <> a.point_id AND r.point_id <> b.point_id AND (r.x - a.x) * (r.x - b.x) + (r.y - a.y) * (r.y - b.y) > 0)))"
HULL = f"{PTS}, he AS (SELECT a.type, a.point_id AS p, b.point_id AS q, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM pts a JOIN pts b ON a.type = b.type AND a.point_id <> b.point_id WHERE NOT EXISTS {_HULL}), hm AS (SELECT type, count(*) AS n_corners, abs(sum(px * qy - qx * py)) / 2 AS area, sum(sqrt(power(px - qx, 2) + power(py - qy, 2))) AS perimeter FROM he GROUP BY type)"


@query(f"WITH {HULL} SELECT type, p, q FROM he")
def hull_edges(spark: SparkSession, sf: str) -> DataFrame:
    return hulls.hull_edges(hulls.hulls(src.pts(spark, sf)))


@query(f"WITH {HULL} SELECT type, n_corners, round(area, 6) AS area, round(perimeter, 6) AS perimeter FROM hm")
def hull_measures(spark: SparkSession, sf: str) -> DataFrame:
    return hulls.hull_measures(hulls.hulls(src.pts(spark, sf))).withColumn("area", r6("area")).withColumn("perimeter", r6("perimeter"))


@query(f"WITH {HULL}, ins AS (SELECT p.point_id, e.type AS hull FROM pts p JOIN he e ON TRUE GROUP BY 1, 2 HAVING bool_and((e.qx - e.px) * (p.y - e.py) - (e.qy - e.py) * (p.x - e.px) <= 1e-9)) SELECT point_id, hull FROM ins")
def point_in_hull(spark: SparkSession, sf: str) -> DataFrame:
    p = src.pts(spark, sf)
    return hulls.points_in_hulls(p, hulls.hulls(p))


@query(f"WITH {HULL}, ins AS (SELECT p.point_id, e.type AS hull FROM pts p JOIN he e ON TRUE GROUP BY 1, 2 HAVING bool_and((e.qx - e.px) * (p.y - e.py) - (e.qy - e.py) * (p.x - e.px) <= 1e-9)) SELECT point_id FROM pts WHERE point_id NOT IN (SELECT i.point_id FROM ins i JOIN pts o ON o.point_id = i.point_id WHERE o.type <> i.hull)")
def points_in_own_hull_only(spark: SparkSession, sf: str) -> DataFrame:
    p = src.pts(spark, sf)
    foreign = hulls.points_in_hulls(p, hulls.hulls(p)).join(p.select("point_id", "type"), "point_id").where("type != hull").select("point_id").distinct()
    return pairs.isolated(p, foreign).select("point_id")


_TRI = "l1 * l2 * l3 / sqrt((l1 + l2 + l3) * (l2 + l3 - l1) * (l3 + l1 - l2) * (l1 + l2 - l3))"


@query(f"""WITH {DS}, w AS (SELECT dataset_id, point_id, x, y, row_number() OVER o AS k, lead(x) OVER o AS x1, lead(y) OVER o AS y1, lead(x, 2) OVER o AS x2, lead(y, 2) OVER o AS y2 FROM ds WINDOW o AS (PARTITION BY dataset_id ORDER BY point_id)),
s AS (SELECT dataset_id, point_id, list_sort([sqrt(power(x - x1, 2) + power(y - y1, 2)), sqrt(power(x1 - x2, 2) + power(y1 - y2, 2)), sqrt(power(x - x2, 2) + power(y - y2, 2))]) AS l FROM w WHERE x2 IS NOT NULL), t AS (SELECT *, l[1] AS l1, l[2] AS l2, l[3] AS l3 FROM s)
SELECT dataset_id, point_id, round(CASE WHEN l3 * l3 <= l1 * l1 + l2 * l2 THEN {_TRI} ELSE l2 / (2 * ((l2 * l2 + l3 * l3 - l1 * l1) / (2 * l2 * l3))) END, 6) AS cover_radius FROM t""")
def triangle_cover_radius(spark: SparkSession, sf: str) -> DataFrame:
    o = Window.partitionBy("dataset_id").orderBy("point_id")
    w = src.pts_ds(spark, sf).select("dataset_id", "point_id", "x", "y", *[F.lead(c, n).over(o).alias(f"{c}{n}") for n in (1, 2) for c in "xy"]).where("x2 is not null")
    d = lambda a, b: distance(F.col(f"x{a}"), F.col(f"y{a}"), F.col(f"x{b}"), F.col(f"y{b}"))
    return w.select("dataset_id", "point_id", r6(cover_radius_triangle(d("", "1"), d("1", "2"), d("", "2"))).alias("cover_radius"))


@query(f"WITH {PTS}, j AS (SELECT a.point_id, b.point_id AS other_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.point_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.point_id) AS k FROM pts a JOIN pts b ON a.type <> b.type) SELECT point_id, other_id, round(d, 6) AS d FROM j WHERE k = 1")
def nearest_other_type(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.nearest_other_type(src.pts(spark, sf)).withColumn("d", r6("d"))


_RGB = "(SELECT p_partkey AS mark_id, (p_size % 17) / 16.0 AS r, (p_partkey % 23) / 22.0 AS g, (p_partkey % 29) / 28.0 AS b FROM part)"
_COLORS = " UNION ALL ".join(f"SELECT {i} AS i, {r!r}::DOUBLE AS cr, {g!r}::DOUBLE AS cg, {b!r}::DOUBLE AS cb" for i, (r, g, b) in enumerate(PALETTE))


@query(f"WITH m AS {_RGB}, c AS ({_COLORS}), j AS (SELECT mark_id, i, row_number() OVER (PARTITION BY mark_id ORDER BY (r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb), i) AS k FROM m, c) SELECT mark_id, CAST(i AS INTEGER) AS type FROM j WHERE k = 1")
def nearest_color(spark: SparkSession, sf: str) -> DataFrame:
    p = src.table(spark, sf, "part")
    marks = p.select(F.col("p_partkey").alias("mark_id"), ((F.col("p_size") % 17) / 16.0).alias("r"), ((F.col("p_partkey") % 23) / 22.0).alias("g"), ((F.col("p_partkey") % 29) / 28.0).alias("b"))
    return pairs.nearest_color(marks, PALETTE).select("mark_id", "type")


GRID = fields.STEP
_M, _T0 = fields.constants()
INFLUENCE = f"""{PTS}, nodes AS (SELECT point_id, type, x, y, unnest(range(CAST(ceil((x - 60) / {GRID}) AS BIGINT), CAST(floor((x + 60) / {GRID}) AS BIGINT) + 1)) AS ix FROM pts),
near AS (SELECT *, unnest(range(CAST(ceil((y - 60) / {GRID}) AS BIGINT), CAST(floor((y + 60) / {GRID}) AS BIGINT) + 1)) AS iy FROM nodes),
inf AS (SELECT type, ix, iy, sum(1 / (power(ix * {GRID} - x, 2) + power(iy * {GRID} - y, 2)) - {_M!r}) AS influence FROM near WHERE power(ix * {GRID} - x, 2) + power(iy * {GRID} - y, 2) < {1 / _M!r} GROUP BY 1, 2, 3),
pot AS (SELECT type, ix, iy, 2 * influence - sum(influence) OVER (PARTITION BY ix, iy) - {_T0!r} AS potential FROM inf)"""


@query(f"WITH {INFLUENCE} SELECT type, ix, iy, round(influence, 6) AS influence FROM inf")
def influence_grid(spark: SparkSession, sf: str) -> DataFrame:
    return fields.influence_grid(src.pts(spark, sf), GRID).withColumn("influence", r6("influence"))


@query(f"WITH {INFLUENCE} SELECT type, ix, iy, round(potential, 6) + 0.0 AS potential FROM pot")
def potential_grid(spark: SparkSession, sf: str) -> DataFrame:
    return fields.potential_grid(src.pts(spark, sf), GRID).withColumn("potential", r6("potential"))


@query(f"WITH {INFLUENCE}, up AS (SELECT * FROM pot WHERE potential > 0), c AS (SELECT type, ix, iy, 1 AS bit FROM up UNION ALL SELECT type, ix - 1, iy, 2 FROM up UNION ALL SELECT type, ix, iy - 1, 4 FROM up UNION ALL SELECT type, ix - 1, iy - 1, 8 FROM up) SELECT type, ix, iy, CAST(sum(bit) AS BIGINT) AS mask FROM c GROUP BY 1, 2, 3 HAVING sum(bit) < 15")
def potential_sign_cells(spark: SparkSession, sf: str) -> DataFrame:
    return fields.sign_cells(fields.potential_grid(src.pts(spark, sf), GRID))


@query(f"WITH {PTS} SELECT t.a AS type1, t.b AS type2, round(min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) / 2, 6) AS first_touch FROM (SELECT DISTINCT a.type AS a, b.type AS b FROM pts a JOIN pts b ON a.type < b.type) t JOIN pts p ON p.type = t.a JOIN pts q ON q.type = t.b GROUP BY 1, 2")
def two_color_first_touch(spark: SparkSession, sf: str) -> DataFrame:
    """When growing discs of two types touch for the first time."""
    return pairs.first_touch(src.pts(spark, sf)).select("type1", "type2", r6(F.col("d") / 2).alias("first_touch"))


@query(f"WITH {PTS}, u AS (SELECT CAST(type AS VARCHAR) AS type FROM pts UNION ALL SELECT event_type FROM events UNION ALL SELECT CAST(c_nationkey AS VARCHAR) FROM customer) SELECT type, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM u GROUP BY type")
def type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Points of three sources by type."""
    every = src.pts(spark, sf).select(F.col("type").cast("string"))
    for more in (src.event_pts(spark, sf), src.account_pts(spark, sf)):
        every = every.unionByName(more.select(F.col("type").cast("string")))
    n = every.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


@query(f"WITH {HULL}, n AS (SELECT type, count(*) AS n FROM pts GROUP BY type), s AS (SELECT abs(coalesce(area, 0) / sum(coalesce(area, 0)) OVER () - n / sum(n) OVER ()) AS gap FROM n LEFT JOIN hm USING (type)) SELECT round(100 * avg(gap), 6) AS mean_percent, round(100 * max(gap), 6) AS max_percent FROM s")
def density_distortion_hull(spark: SparkSession, sf: str) -> DataFrame:
    p = src.pts(spark, sf)
    d = sets.density_distortion(hulls.hull_measures(hulls.hulls(p)).select("type", "area"), p)
    return d.select(r6("mean_percent").alias("mean_percent"), r6("max_percent").alias("max_percent"))


HISTORY = "h AS (SELECT user_id % 20 AS dataset_id, event_id AS seq, value AS time FROM events)"


@query(f"WITH {HISTORY}, l AS (SELECT *, max(CASE WHEN time >= 90 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id ORDER BY seq) AS late FROM h) SELECT dataset_id, max(seq) AS seq, arg_max(time, seq) AS time FROM l WHERE late = 0 GROUP BY 1")
def history_cut(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "events").select((F.col("user_id") % 20).alias("dataset_id"), F.col("event_id").alias("seq"), F.col("value").alias("time"))
    return sets.history_cut(e, 90.0)


HYPER = "he AS (SELECT l_orderkey AS edge_id, list_sort(list_distinct(list(CAST(l_suppkey % 12 AS INTEGER)))) AS origins FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 12) > 1)"


@query(f"WITH {HYPER}, d AS (SELECT DISTINCT origins FROM he) SELECT edge_id, CAST(origins AS VARCHAR) AS origins FROM he s WHERE NOT EXISTS (SELECT 1 FROM d b WHERE len(b.origins) = len(s.origins) + 1 AND list_has_all(b.origins, s.origins))")
def hyperedge_prune(spark: SparkSession, sf: str) -> DataFrame:
    l = src.table(spark, sf, "lineitem")
    edges = l.groupBy(F.col("l_orderkey").alias("edge_id")).agg(F.array_sort(F.collect_set((F.col("l_suppkey") % 12).cast("int"))).alias("origins")).where(F.size("origins") > 1)
    return sets.prune_hyperedges(edges).select("edge_id", F.concat(F.lit("["), F.array_join("origins", ", "), F.lit("]")).alias("origins"))


PREF = "r AS (SELECT o_orderkey AS component_id, o_custkey % 4 AS left_discs, o_orderkey % 4 AS right_discs, o_custkey % 3 = 0 AS left_straight, o_orderkey % 5 = 0 AS right_straight, o_custkey % 2 = 0 AS left_bent, o_orderkey % 7 < 3 AS right_bent FROM orders)"


@query(f"WITH {PREF} SELECT component_id, CASE WHEN left_discs < right_discs THEN 'LT' WHEN left_discs > right_discs THEN 'GT' WHEN left_bent AND NOT right_bent THEN 'LT' WHEN right_bent AND NOT left_bent THEN 'GT' WHEN left_straight AND NOT right_straight THEN 'LT' WHEN right_straight AND NOT left_straight THEN 'GT' ELSE 'EQ' END AS preference FROM r")
def preference_resolve(spark: SparkSession, sf: str) -> DataFrame:
    o, c, k = src.table(spark, sf, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    r = o.select(k.alias("component_id"), (c % 4).alias("left_discs"), (k % 4).alias("right_discs"), (c % 3 == 0).alias("left_straight"), (k % 5 == 0).alias("right_straight"), (c % 2 == 0).alias("left_bent"), (k % 7 < 3).alias("right_bent"))
    return sets.resolve_preference(r).select("component_id", "preference")


@query(f"WITH {PTS} SELECT point_id, CASE WHEN type IN (2, 5) THEN 99 ELSE type END AS pattern_id FROM pts WHERE type <> (SELECT type FROM pts WHERE point_id = 7) OR type IN (2, 5) AND (SELECT type FROM pts WHERE point_id = 7) NOT IN (2, 5) UNION ALL SELECT point_id, -1 - point_id FROM pts WHERE point_id <> 7 AND CASE WHEN type IN (2, 5) THEN 99 ELSE type END = (SELECT CASE WHEN type IN (2, 5) THEN 99 ELSE type END FROM pts WHERE point_id = 7)")
def partition_edit(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns 2 and 5 merged, then the pattern of point 7 broken up and the point removed."""
    m = src.pts(spark, sf).select("point_id", F.col("type").cast("long").alias("pattern_id"))
    return sets.break_pattern(sets.merge_patterns(m, 2, 5, 99), 7)


@query(f"""WITH {PTS} SELECT point_id, '<circle cx="' || {_sql_decimal('x')} || '" cy="' || {_sql_decimal('y')} || '" r="2.0"/>' AS svg FROM pts""")
def svg_points(spark: SparkSession, sf: str) -> DataFrame:
    return src.pts(spark, sf).select("point_id", drawing.circle_tag(F.col("x"), F.col("y"), 2.0).alias("svg"))


@query(f"WITH {PTS} SELECT point_id, floor(x / 5 + 0.5) * 5 AS gx, floor(y / 5 + 0.5) * 5 AS gy, floor(x * 10 + 0.5) / 10 AS rx FROM pts")
def grid_snap(spark: SparkSession, sf: str) -> DataFrame:
    p = src.pts(spark, sf)
    return p.select("point_id", (round_half_up(F.col("x") / 5, 0) * 5).alias("gx"), (round_half_up(F.col("y") / 5, 0) * 5).alias("gy"), round_half_up(F.col("x"), 1).alias("rx"))




# Sources and sinks: what is written is read again.

_R3 = "(floor(({0}) * 1000 + 0.5) / 1000)".format


def _documents(elements: DataFrame) -> DataFrame:
    """(dataset_id, z, ipe) -> one Ipe file a dataset, as the sources read them."""
    return drawing.ipe_page(elements).select(F.col("dataset_id").alias("dataset"), F.col("document").alias("value"))


@query(f"WITH {DS} SELECT dataset_id AS dataset, row_number() OVER (PARTITION BY dataset_id ORDER BY point_id) - 1 AS point_id, type, {_R3('x')} AS x, {_R3('y')} AS y FROM ds")
def ipe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Points written as marks of Ipe drawings and read from them."""
    marks = src.pts_ds(spark, sf).select("dataset_id", F.col("point_id").alias("z"), drawing.ipe_mark(F.col("x"), F.col("y"), F.col("type")).alias("ipe"))
    return src.ipe_points(_documents(marks))


BOXES = f"{DS}, bx AS (SELECT dataset_id, type, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ds GROUP BY 1, 2), rb AS (SELECT dataset_id, type, {_R3('x0 - 7.25')} AS x0, {_R3('x1 + 7.25')} AS x1, {_R3('y0 - 7.25')} AS y0, {_R3('y1 + 7.25')} AS y1 FROM bx)"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """(dataset_id, type, x0, x1, y0, y1): each type's box, a little larger, on thousandths."""
    b = src.pts_ds(spark, sf).groupBy("dataset_id", "type").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return b.select("dataset_id", "type", *[round_half_up(F.col(c) + d).alias(c) for c, d in (("x0", -7.25), ("x1", 7.25), ("y0", -7.25), ("y1", 7.25))])


def _box_ring(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> F.Column:
    return F.array(*[F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


@query(f"WITH {BOXES} SELECT dataset_id AS dataset, row_number() OVER (PARTITION BY dataset_id ORDER BY type) - 1 AS region_id, 'CART ' || (type + 1) AS color, TRUE AS closed, 4 AS corners, round((x1 - x0) * (y1 - y0), 4) AS area FROM rb")
def ipe_regions_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes written as paths of Ipe drawings and read from them."""
    paths = _boxes(spark, sf).select("dataset_id", F.col("type").alias("z"), drawing.ipe_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("type")).alias("ipe"))
    return src.ipe_regions(_documents(paths)).select("dataset", "region_id", "color", "closed", F.size("ring").alias("corners"), F.round(F.abs(ring_area(F.col("ring"))), 4).alias("area"))


PARSED = f"""{BOXES}, ho AS (SELECT dataset_id, type, {_R3('x0 + 0.3 * (x1 - x0)')} AS x0, {_R3('x1 - 0.3 * (x1 - x0)')} AS x1, {_R3('y0 + 0.3 * (y1 - y0)')} AS y0, {_R3('y1 - 0.3 * (y1 - y0)')} AS y1 FROM rb),
p AS (SELECT dataset_id, type, {_R3('x')} AS x, {_R3('y')} AS y, row_number() OVER (PARTITION BY dataset_id ORDER BY point_id) - 1 AS point_id FROM ds),
n AS (SELECT dataset_id, count(*) AS n FROM p GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY type) - 1 AS k FROM rb),
i AS (SELECT r.dataset_id, r.k, p.point_id, p.type, r.x0, r.x1, r.y0, r.y1, p.x, p.y FROM r JOIN p ON p.dataset_id = r.dataset_id AND p.x > r.x0 AND p.x < r.x1 AND p.y > r.y0 AND p.y < r.y1),
f AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM ho h WHERE h.dataset_id = i.dataset_id AND h.x0 > i.x0 AND h.x1 < i.x1 AND h.y0 > i.y0 AND h.y1 < i.y1 AND i.x > h.x0 AND i.x < h.x1 AND i.y > h.y0 AND i.y < h.y1)),
m AS (SELECT * FROM f UNION ALL SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.dataset_id = i.dataset_id AND f.k = i.k))"""


@query(f"""WITH {PARSED} SELECT m.dataset_id, n.n + m.k AS shape_id, count(*) AS n_points, sum(point_id) AS ids, count(DISTINCT type) > 1 AS mixed FROM m JOIN n ON n.dataset_id = m.dataset_id GROUP BY m.dataset_id, n.n, m.k
UNION ALL SELECT dataset_id, NULL, 1, point_id, FALSE FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.dataset_id = p.dataset_id AND m.point_id = p.point_id)""")
def svg_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Drawings of points, regions and holes written as SVG and read again: regions with their members, points of none."""
    from .sources import svg

    b = _boxes(spark, sf)
    h = b.select("dataset_id", "type", *[round_half_up(F.expr(e)).alias(c) for c, e in (("x0", "x0 + 0.3 * (x1 - x0)"), ("x1", "x1 - 0.3 * (x1 - x0)"), ("y0", "y0 + 0.3 * (y1 - y0)"), ("y1", "y1 - 0.3 * (y1 - y0)"))])
    dots = src.pts_ds(spark, sf).select("dataset_id", F.col("point_id").alias("z"), F.concat(F.lit('<g stroke="#000000" fill="'), drawing.color_of(F.col("type")), F.lit('">'), drawing.circle_tag(F.col("x"), F.col("y"), 1.0), F.lit("</g>")).alias("svg"))
    regions = b.select("dataset_id", (F.lit(1 << 40) + F.col("type")).alias("z"), drawing.path_tag(_box_ring(), F.col("type")).alias("svg"))
    holes = h.select("dataset_id", (F.lit(1 << 41) + F.col("type")).alias("z"), F.concat(F.lit('<path d="'), drawing.path_data(_box_ring()), F.lit('" fill="#ffffff" stroke="none"/>')).alias("svg"))
    files = drawing.render(dots.unionByName(regions).unionByName(holes)).select("dataset_id", F.col("document").alias("value"))
    _, patterns = svg.parse_svg(files, 1.0, check_holes=True)
    return patterns.select("dataset_id", "shape_id", F.size("point_ids").cast("long").alias("n_points"), F.aggregate("point_ids", F.lit(0).cast("long"), lambda s, i: s + i).alias("ids"), "mixed")


@query(f"WITH {DS} SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY type, point_id) - 1 AS point_id, type, round({_R3('x')}, 6) + 0.0 AS x, round({_R3('y')}, 6) + 0.0 AS y FROM ds")
def svg_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Points written as circles in nested groups, of which the inner ones have a type's colour, and read again."""
    from .sources import svg

    p = src.pts_ds(spark, sf)
    nodes = lambda rows, path, attributes, text: rows.select("dataset_id", F.array(*[c.cast("long") for c in path]).alias("path"), F.create_map(*attributes).alias("attributes"), text.alias("svg"))
    none, zero = F.lit(None).cast("string"), F.lit(0)
    types = p.select("dataset_id", "type").distinct()
    tree = nodes(p.select("dataset_id").distinct(), [zero], [F.lit("stroke"), F.lit("#000000")], none)
    tree = tree.unionByName(nodes(types, [zero, F.col("type")], [F.lit("fill"), drawing.color_of(F.col("type"))], none))
    tree = tree.unionByName(nodes(p, [zero, F.col("type"), F.col("point_id")], [F.lit("id"), F.col("point_id").cast("string")], drawing.circle_tag(F.col("x"), F.col("y"), 1.0)))
    points, _ = svg.parse_svg(drawing.tree_svg(tree).select("dataset_id", F.col("document").alias("value")), 1.0)
    return points.select("dataset_id", "point_id", "type", r6("x").alias("x"), r6("y").alias("y"))


@query(f"WITH {PTS}, c(i, r, g, b) AS (VALUES {', '.join(f'({i}, {r!r}::DOUBLE, {g!r}::DOUBLE, {b!r}::DOUBLE)' for i, (r, g, b) in enumerate(PALETTE))}), t AS (SELECT DISTINCT type FROM pts UNION ALL SELECT 40) SELECT type, coalesce(format('#{{:02x}}{{:02x}}{{:02x}}', CAST(round_even(255 * r, 0) AS INTEGER), CAST(round_even(255 * g, 0) AS INTEGER), CAST(round_even(255 * b, 0) AS INTEGER)), '#ffffff') AS color, coalesce(format('#{{:02x}}{{:02x}}{{:02x}}', CAST(round_even(255 * (r + (1 - r) * 0.7), 0) AS INTEGER), CAST(round_even(255 * (g + (1 - g) * 0.7), 0) AS INTEGER), CAST(round_even(255 * (b + (1 - b) * 0.7), 0) AS INTEGER)), '#ffffff') AS light FROM t LEFT JOIN c ON i = type")
def type_colors(spark: SparkSession, sf: str) -> DataFrame:
    t = src.pts(spark, sf).select("type").distinct().unionByName(spark.createDataFrame([(40,)], "type int"))
    return t.select("type", drawing.color_of(F.col("type")).alias("color"), drawing.color_of(F.col("type"), 0.7).alias("light"))


@query("SELECT o_orderkey AS request_id, CASE o_orderkey % 3 WHEN 0 THEN 'change_cover' WHEN 1 THEN 'draw' ELSE 'compute' END AS kind, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 5 > 0 THEN o_custkey / 4.0 END AS cover, CASE WHEN o_orderkey % 3 = 2 THEN o_custkey / 8.0 END AS p_size, CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END AS n_points, o_orderkey % 3 > 0 OR o_custkey % 5 > 0 AS valid FROM orders")
def request_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as JSON lines, decoded."""
    from .plans.protocol import parse_requests

    o, k, c = src.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    cover = F.when(k % 3 == 0, F.struct(F.lit("change_cover").alias("kind"), F.when(c % 5 > 0, c / 4.0).alias("cover")))
    draw = F.struct(F.lit("draw").alias("kind"), F.lit(0.5).alias("whiten"))
    point = F.struct(F.lit(1).alias("dataset_id"), k.alias("point_id"), F.lit(0).alias("type"), F.lit(1.5).alias("x"), F.lit(2.5).alias("y"))
    compute = F.struct(F.lit("compute").alias("kind"), F.array(point).alias("points"), F.struct((c / 8.0).alias("p_size")).alias("settings"))
    text = F.when(k % 3 == 0, F.to_json(cover)).when(k % 3 == 1, F.to_json(draw)).otherwise(F.to_json(compute))
    r = parse_requests(o.select(k.alias("request_id"), text.alias("value")))
    return r.select("request_id", "kind", "cover", F.col("settings.p_size").alias("p_size"), F.coalesce(F.size("points"), F.lit(0)).alias("n_points"), "valid")


# Contours: kernels on rings whose results SQL can state.

GROUPS = f"{DS}, gp AS (SELECT dataset_id, dataset_id * 100 + type AS g, point_id, x, y FROM ds)"
GHULL = f"""{GROUPS}, ge AS (SELECT a.dataset_id, a.g, a.point_id AS p, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM gp a JOIN gp b ON a.g = b.g AND a.point_id <> b.point_id WHERE NOT EXISTS (SELECT 1 FROM gp r WHERE r.g = a.g AND ((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) > 1e-9 OR (abs((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x)) <= 1e-9 AND r.point_id <> a.point_id AND r.point_id <> b.point_id AND (r.x - a.x) * (r.x - b.x) + (r.y - a.y) * (r.y - b.y) > 0)))),
h3 AS (SELECT dataset_id, g FROM ge GROUP BY 1, 2 HAVING count(*) > 2), he AS (SELECT ge.* FROM ge SEMI JOIN h3 ON h3.g = ge.g),
cx AS (SELECT a.dataset_id, a.g AS g1, b.g AS g2 FROM he a JOIN he b ON a.dataset_id = b.dataset_id AND a.g < b.g WHERE ((a.qx - a.px) * (b.py - a.py) - (a.qy - a.py) * (b.px - a.px)) * ((a.qx - a.px) * (b.qy - a.py) - (a.qy - a.py) * (b.qx - a.px)) < 0 AND ((b.qx - b.px) * (a.py - b.py) - (b.qy - b.py) * (a.px - b.px)) * ((b.qx - b.px) * (a.qy - b.py) - (b.qy - b.py) * (a.qx - b.px)) < 0)"""


def _hulls(spark: SparkSession, sf: str) -> DataFrame:
    """(dataset_id, g, ring): hulls with an area, of each dataset's types."""
    p = src.pts_ds(spark, sf).select("point_id", "x", "y", (F.col("dataset_id") * 100 + F.col("type")).alias("g"))
    return hulls.hulls(p, "g").where(F.size("ids") > 2).select(F.floor(F.col("g") / 100).alias("dataset_id"), "g", "ring")


@query(f"WITH {GHULL}, vin AS (SELECT v.dataset_id, v.g AS g1, e.g AS g2 FROM he v JOIN he e ON v.dataset_id = e.dataset_id AND v.g <> e.g GROUP BY v.dataset_id, v.g, v.p, e.g HAVING bool_and((e.qx - e.px) * (v.py - e.py) - (e.qy - e.py) * (v.px - e.px) <= 0)), u AS (SELECT * FROM cx UNION SELECT dataset_id, least(g1, g2), greatest(g1, g2) FROM vin) SELECT DISTINCT dataset_id, g1, g2 FROM u")
def contours_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of types of a dataset whose hulls overlap."""
    from .operators.grids import boxes_meet
    from .sources.svg import rings_meet

    h = _hulls(spark, sf)
    one, two = h.select("dataset_id", F.col("g").alias("g1"), "ring"), h.select("dataset_id", F.col("g").alias("g2"), F.col("ring").alias("other"))
    return boxes_meet(one, two, ("dataset_id",)).where("g1 < g2").where(rings_meet(F.col("ring"), F.col("other"))).select("dataset_id", "g1", "g2")


_TO_EDGE = "sqrt(power(v.x - (e.px + greatest(0, least(1, ((v.x - e.px) * (e.qx - e.px) + (v.y - e.py) * (e.qy - e.py)) / (power(e.qx - e.px, 2) + power(e.qy - e.py, 2)))) * (e.qx - e.px)), 2) + power(v.y - (e.py + greatest(0, least(1, ((v.x - e.px) * (e.qx - e.px) + (v.y - e.py) * (e.qy - e.py)) / (power(e.qx - e.px, 2) + power(e.qy - e.py, 2)))) * (e.qy - e.py)), 2))"


@query(f"WITH {GHULL} SELECT v.point_id, v.g, round(min({_TO_EDGE}), 6) AS d FROM gp v JOIN he e ON e.g = v.g GROUP BY 1, 2")
def contour_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Each point's distance from the outline of its own type's hull."""
    p = src.pts_ds(spark, sf).select("point_id", "x", "y", (F.col("dataset_id") * 100 + F.col("type")).alias("g"))
    return p.join(_hulls(spark, sf), "g").select("point_id", "g", r6(ring_distance(F.col("ring"), F.col("x"), F.col("y"))).alias("d"))


@query(f"""WITH RECURSIVE {GHULL}, tie AS (SELECT DISTINCT g1 AS a, g2 AS b FROM cx UNION SELECT DISTINCT g2, g1 FROM cx), walk AS (SELECT g AS n, g AS c FROM h3 UNION SELECT tie.b, walk.c FROM walk JOIN tie ON walk.n = tie.a WHERE tie.b > walk.c), comp AS (SELECT n, min(c) AS c FROM walk GROUP BY n),
v AS (SELECT dataset_id, count(*) AS k FROM cx GROUP BY 1), e AS (SELECT dataset_id, count(*) AS k FROM he GROUP BY 1), c AS (SELECT h3.dataset_id, count(DISTINCT comp.c) AS k FROM comp JOIN h3 ON h3.g = comp.n GROUP BY 1)
SELECT e.dataset_id, coalesce(v.k, 0) AS n_vertices, e.k + 2 * coalesce(v.k, 0) AS n_edges, coalesce(v.k, 0) + c.k AS n_faces FROM e LEFT JOIN v ON v.dataset_id = e.dataset_id JOIN c ON c.dataset_id = e.dataset_id""")
def arrangement_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Crossings, edges and faces of each dataset's hulls; the SQL counts faces by Euler's formula."""
    from .operators.planar_map import PlanarMap

    return PlanarMap(_hulls(spark, sf), ring="g").counts()


DEPTHS_OF_SETS = f"{BOXES}, xs AS (SELECT dataset_id, v, lead(v) OVER (PARTITION BY dataset_id ORDER BY v) AS w FROM (SELECT dataset_id, x0 AS v FROM rb UNION SELECT dataset_id, x1 FROM rb)), ys AS (SELECT dataset_id, v, lead(v) OVER (PARTITION BY dataset_id ORDER BY v) AS w FROM (SELECT dataset_id, y0 AS v FROM rb UNION SELECT dataset_id, y1 FROM rb)), ds2 AS (SELECT xs.dataset_id, xs.v AS x, ys.v AS y, (xs.w - xs.v) * (ys.w - ys.v) AS a, coalesce(list(rb.type ORDER BY rb.type) FILTER (rb.type IS NOT NULL), []) AS origins FROM xs JOIN ys ON ys.dataset_id = xs.dataset_id LEFT JOIN rb ON rb.dataset_id = xs.dataset_id AND rb.x0 <= xs.v AND rb.x1 >= xs.w AND rb.y0 <= ys.v AND rb.y1 >= ys.w WHERE xs.w IS NOT NULL AND ys.w IS NOT NULL GROUP BY xs.dataset_id, xs.v, xs.w, ys.v, ys.w)"


def _box_map(spark: SparkSession, sf: str):
    from .operators.planar_map import PlanarMap

    return PlanarMap(_boxes(spark, sf).select("dataset_id", F.col("type").alias("ring_id"), _box_ring().alias("ring")))


@query(f"""WITH {DEPTHS_OF_SETS} SELECT dataset_id, array_to_string(origins, ' ') AS origins, round(sum(a), 6) AS area FROM ds2 WHERE len(origins) > 0 GROUP BY 1, 2""")
def face_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Area of the faces of each dataset's boxes, by the boxes that hold them."""
    f = _box_map(spark, sf).net_areas()
    return f.where(F.size("origins") > 0).groupBy("dataset_id", F.array_join("origins", " ").alias("origins")).agg(F.round(F.sum("area"), 6).alias("area")).where("area > 0")


@query(f"""WITH {BOXES}, p AS (SELECT a.dataset_id, a.type AS i, b.type AS j, [a.x0 > b.x0, a.y0 > b.y0, a.x1 < b.x1, a.y1 < b.y1] AS own, [least(a.y1, b.y1) - greatest(a.y0, b.y0), least(a.x1, b.x1) - greatest(a.x0, b.x0)] AS side FROM rb a JOIN rb b ON a.dataset_id = b.dataset_id AND a.type < b.type AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
s AS (SELECT dataset_id, i, j, CASE WHEN mine THEN i ELSE j END AS ring, k, o.own = mine AS on_it, own_before = mine AS before, CASE WHEN k % 2 = 0 THEN side[1] ELSE side[2] END AS length FROM (SELECT *, own[k + 1] AS own1, own[(k + 3) % 4 + 1] AS own_before FROM (SELECT *, unnest([0, 1, 2, 3]) AS k FROM p)) q, (VALUES (true), (false)) m(mine), LATERAL (SELECT q.own1 AS own) o)
SELECT dataset_id, i, j, ring, CASE WHEN bool_and(on_it) THEN 1 ELSE sum(CASE WHEN on_it AND NOT before THEN 1 ELSE 0 END) END AS n_parts, round(sum(CASE WHEN on_it THEN length ELSE 0 END), 3) + 0.0 AS length FROM s GROUP BY dataset_id, i, j, ring""")
def boundary_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Where two boxes of a dataset overlap: in how many stretches the overlap's border runs along each, and how long."""
    b = _box_map(spark, sf).boundary_parts()
    return b.groupBy("dataset_id", "i", "j", "ring").agg(F.sum("n_parts").alias("n_parts"), (F.round(F.sum("length"), 3) + 0.0).alias("length"))


@query(f"""WITH {GROUPS}, o AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM gp WINDOW w AS (PARTITION BY g ORDER BY point_id)), s AS (SELECT a.g, a.k, a.n, a.x, a.y, b.x AS nx, b.y AS ny, atan2(b.y - a.y, b.x - a.x) AS h FROM o a JOIN o b ON b.g = a.g AND b.k = (a.k + 1) % a.n WHERE a.n > 2),
t AS (SELECT s.*, z.h - s.h AS d FROM s JOIN s z ON z.g = s.g AND z.k = (s.k + 1) % s.n)
SELECT g, round(abs(sum(x * ny - nx * y)) / 2, 5) AS area, round(sum(sqrt(power(nx - x, 2) + power(ny - y, 2))), 6) AS length, round(sum(abs(d - 2 * pi() * floor((d + pi()) / (2 * pi())))) - 2 * pi(), 6) AS curvature FROM t GROUP BY g""")
def ring_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Area, length and total absolute curvature of the rings through the points of each dataset's types."""
    from .operators.metrics import ring_measures as measures

    p = src.pts_ds(spark, sf).select((F.col("dataset_id") * 100 + F.col("type")).alias("g"), F.struct("point_id", "x", "y").alias("p"))
    rings = p.groupBy("g").agg(F.transform(F.array_sort(F.collect_list("p")), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("ring")).where(F.size("ring") > 2)
    return measures(rings, "g").select("g", F.round("area", 5).alias("area"), r6("length").alias("length"), r6("curvature").alias("curvature"))


@query(f"""WITH {GHULL}, n AS (SELECT dataset_id, g, count(*) AS n FROM gp GROUP BY 1, 2), l AS (SELECT a.g, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM gp a JOIN gp b ON a.g = b.g AND a.point_id < b.point_id JOIN n ON n.g = a.g AND n.n = 2),
m AS (SELECT n.g, n.n, coalesce(h.area, 0) AS area, coalesce(h.length, 2 * l.d, 0) AS length, coalesce(h.k, CASE WHEN n.n = 2 THEN 2 ELSE 0 END) AS k FROM n LEFT JOIN l ON l.g = n.g LEFT JOIN (SELECT g, abs(sum(px * qy - qx * py)) / 2 AS area, sum(sqrt(power(qx - px, 2) + power(qy - py, 2))) AS length, count(*) AS k FROM he GROUP BY g) h ON h.g = n.g)
SELECT g, CASE n WHEN 1 THEN 'single' WHEN 2 THEN 'matching' ELSE 'island' END AS kind, CAST(k AS BIGINT) AS n_lines, round(area + 6 * length + 36 * pi(), 5) AS area, round(length + 12 * pi(), 6) AS length FROM m""")
def dilated_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The regions at distance 6 around each dataset's types, taken as singles, matchings and islands: exact measures of
    their lines and arcs.
    """
    from .functions import arcs

    p = src.pts_ds(spark, sf).select("point_id", "x", "y", (F.col("dataset_id") * 100 + F.col("type")).alias("g"))
    size = p.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    c = hulls.hulls(p, "g").join(size, "g").withColumn("contour", arcs.around_ring(F.reverse("ring"), 6.0))
    kind = F.when(F.col("n") == 1, "single").when(F.col("n") == 2, "matching").otherwise("island")
    n_lines = F.size(F.filter("contour", lambda s: s["turn"] == 0)).cast("long")
    return c.select("g", kind.alias("kind"), n_lines.alias("n_lines"), F.round(arcs.area(F.col("contour")), 5).alias("area"), r6(arcs.length(F.col("contour"))).alias("length"))


_XS = "SELECT dataset_id, x0 AS v FROM rb UNION SELECT dataset_id, x1 FROM rb"
_YS = "SELECT dataset_id, y0 AS v FROM rb UNION SELECT dataset_id, y1 FROM rb"
DEPTHS = f"{BOXES}, xs AS (SELECT dataset_id, v, lead(v) OVER (PARTITION BY dataset_id ORDER BY v) AS w FROM ({_XS})), ys AS (SELECT dataset_id, v, lead(v) OVER (PARTITION BY dataset_id ORDER BY v) AS w FROM ({_YS})), dp AS (SELECT xs.dataset_id, (xs.w - xs.v) * (ys.w - ys.v) AS a, (SELECT count(*) FROM rb WHERE rb.dataset_id = xs.dataset_id AND rb.x0 <= xs.v AND rb.x1 >= xs.w AND rb.y0 <= ys.v AND rb.y1 >= ys.w) AS depth FROM xs JOIN ys ON ys.dataset_id = xs.dataset_id WHERE xs.w IS NOT NULL AND ys.w IS NOT NULL)"


@query(f"WITH {DEPTHS} SELECT dataset_id, round(sum(CASE WHEN depth > 0 THEN a ELSE 0 END), 3) AS any_area, round(sum(CASE WHEN depth > 1 THEN a ELSE 0 END), 3) AS many_area, round(sum(CASE WHEN depth % 2 = 1 THEN a ELSE 0 END), 3) AS odd_area, round(sum(CASE WHEN depth > 0 THEN a ELSE 0 END) - sum(CASE WHEN depth > 1 THEN a ELSE 0 END), 3) AS one_area FROM dp GROUP BY 1")
def box_booleans(spark: SparkSession, sf: str) -> DataFrame:
    """Areas of Boolean combinations of each dataset's boxes: covered by any, by several, by an odd number, by just one."""
    from .operators.clipping import depth_areas

    areas = depth_areas(_box_map(spark, sf))
    return areas.select("dataset_id", *[F.round(c, 3).alias(c) for c in ("any_area", "many_area", "odd_area", "one_area")])


#: Of two types the one lies above from which the other is one to four steps on, around ten; five apart, the greater.
_OVER = "(({a} + 10 - {b}) % 10 IN (1, 2, 3, 4) OR (({a} + 10 - {b}) % 10 = 5 AND {a} > {b}))"
TOPS = f"""{DEPTHS_OF_SETS}, lv AS (SELECT *, [len([1 FOR u IN origins IF u <> t AND {_OVER.format(a='t', b='u')}]) FOR t IN origins] AS wins FROM ds2),
tp AS (SELECT *, CASE WHEN len(origins) > 0 AND len(list_distinct(wins)) = len(wins) THEN origins[list_position(wins, len(wins) - 1)] END AS top FROM lv)"""


def _layers(spark: SparkSession, sf: str):
    from .operators.face_drawing import face_layers

    m = _box_map(spark, sf)
    t = m.rings.select("dataset_id", F.col("ring_id").alias("over"))
    both = t.join(t.withColumnRenamed("over", "under"), "dataset_id").where("over != under")
    return m, face_layers(m, both.where(_OVER.format(a="over", b="under")))


@query(f"WITH {TOPS} SELECT dataset_id, array_to_string(origins, ' ') AS origins, coalesce(top, -1) AS top, round(sum(a), 6) AS area FROM tp WHERE len(origins) > 0 GROUP BY 1, 2, 3")
def face_tops(spark: SparkSession, sf: str) -> DataFrame:
    """What lies on top in the faces of each dataset's boxes, which lie above each other in circles; -1: a circle within a
    face.
    """
    from .operators.face_drawing import tops

    m, layers = _layers(spark, sf)
    f = m.net_areas().join(tops(layers), "face", "left").where(F.size("origins") > 0)
    return f.groupBy("dataset_id", F.array_join("origins", " ").alias("origins"), F.coalesce("top", F.lit(-1)).alias("top")).agg(F.round(F.sum("area"), 6).alias("area")).where("area > 0")


@query(f"""WITH {TOPS}, n AS (SELECT *, dense_rank() OVER (PARTITION BY dataset_id ORDER BY x) AS i, dense_rank() OVER (PARTITION BY dataset_id ORDER BY y) AS j FROM tp), w AS (SELECT DISTINCT dataset_id, i, lead(x) OVER (PARTITION BY dataset_id, j ORDER BY i) - x AS dx FROM n), h AS (SELECT DISTINCT dataset_id, j, lead(y) OVER (PARTITION BY dataset_id, i ORDER BY j) - y AS dy FROM n),
s AS (SELECT a.dataset_id, a.top, CASE WHEN b.i > a.i THEN h.dy ELSE w.dx END AS d FROM n a JOIN n b ON a.dataset_id = b.dataset_id AND ((b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1)) AND a.top = b.top AND a.origins <> b.origins LEFT JOIN w ON w.dataset_id = a.dataset_id AND w.i = a.i LEFT JOIN h ON h.dataset_id = a.dataset_id AND h.j = a.j)
SELECT dataset_id, top, round(sum(d), 3) AS length FROM s GROUP BY 1, 2""")
def face_seams(spark: SparkSession, sf: str) -> DataFrame:
    """How long the seams between faces of one top are."""
    from .operators.face_drawing import seams

    m, layers = _layers(spark, sf)
    d = distance(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")) / 1e6
    return seams(m, layers).groupBy("dataset_id", "top").agg(F.round(F.sum(d), 3).alias("length"))


_FILLED = {"even_odd": "{} % 2 <> 0", "non_zero": "{} <> 0", "positive": "{} > 0", "negative": "{} < 0"}
_KEPT = {"intersection": "({}) AND ({})", "union": "({}) OR ({})", "difference": "({}) AND NOT ({})", "xor": "({}) <> ({})"}
_CLIPS = " UNION ALL ".join(f"SELECT dataset_id, '{o}' AS operation, '{r}' AS rule, a FROM w WHERE {_KEPT[o].format(_FILLED[r].format('s'), _FILLED[r].format('c'))}" for o in _KEPT for r in _FILLED)


@query(f"""WITH {DEPTHS_OF_SETS}, w AS (SELECT dataset_id, a, coalesce(list_sum([CASE WHEN t % 3 = 0 THEN -1 ELSE 1 END FOR t IN origins IF t % 2 = 0]), 0) AS s, coalesce(list_sum([CASE WHEN t % 3 = 0 THEN -1 ELSE 1 END FOR t IN origins IF t % 2 = 1]), 0) AS c FROM ds2)
SELECT dataset_id, operation, rule, round(sum(a), 6) AS area FROM ({_CLIPS}) GROUP BY 1, 2, 3""")
def fill_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Areas of the boxes of even types combined with those of odd ones, by all operations and fill rules; every third type
    goes around clockwise.
    """
    from .operators.clipping import clip_areas
    from .operators.planar_map import PlanarMap

    b = _boxes(spark, sf)
    ring = F.when(F.col("type") % 3 == 0, F.reverse(_box_ring())).otherwise(_box_ring())
    m = PlanarMap(b.select("dataset_id", F.col("type").alias("ring_id"), ring.alias("ring"), (F.col("type") % 2 == 1).alias("clip")))
    return clip_areas(m, F.col("clip")).select("dataset_id", "operation", "rule", F.round("area", 6).alias("area"))


@query(f"""WITH {DS}, h AS (SELECT dataset_id, type, point_id, x, y, lead(x) OVER o AS nx, lead(y) OVER o AS ny, coalesce(sqrt(power(lead(x) OVER o - x, 2) + power(lead(y) OVER o - y, 2)), 0) AS hop, count(*) OVER (PARTITION BY dataset_id, type) AS n FROM ds WINDOW o AS (PARTITION BY dataset_id, type ORDER BY point_id)),
c AS (SELECT *, sum(hop) OVER (PARTITION BY dataset_id, type ORDER BY point_id) - hop AS sofar, sum(hop) OVER (PARTITION BY dataset_id, type) AS total FROM h WHERE n > 1),
q AS (SELECT dataset_id, type, total, s, x + (nx - x) * (s * total - sofar) / hop AS px, y + (ny - y) * (s * total - sofar) / hop AS py FROM c, (SELECT unnest([0.25, 0.75])::DOUBLE AS s) WHERE hop > 0 AND sofar <= s * total AND s * total < sofar + hop)
SELECT dataset_id, type, round(any_value(total) / 2, 6) AS length, round(max(CASE WHEN s = 0.25 THEN px END), 6) + 0.0 AS x0, round(max(CASE WHEN s = 0.25 THEN py END), 6) + 0.0 AS y0, round(max(CASE WHEN s = 0.75 THEN px END), 6) + 0.0 AS x1, round(max(CASE WHEN s = 0.75 THEN py END), 6) + 0.0 AS y1 FROM q GROUP BY 1, 2""")
def bank_middle(spark: SparkSession, sf: str) -> DataFrame:
    """The middle half of each bank: its length and ends."""
    from .operators.banks import part_between

    m = part_between(src.pts_ds(spark, sf), 0.25, 0.75)
    return m.select("dataset_id", "type", *[r6(c).alias(c) for c in ("length", "x0", "y0", "x1", "y1")])


# Kernels: sequential or geometric loops that SQL can't express; the tests hold them against brute force, closed forms and
# properties.

SMALL = {"p_size": 4.0, "cover": 4.0}


def _settings(**more):
    from .settings import Settings

    return Settings(**SMALL, **more)


@query()
def grow_history(spark: SparkSession, sf: str) -> DataFrame:
    from .operators.growth import grow

    return grow(src.pts_ds(spark, sf), _settings())


@query()
def grow_cut(spark: SparkSession, sf: str) -> DataFrame:
    from .operators.growth import cut, grow

    s = _settings(postpone_intersections=False)
    return cut(grow(src.pts_ds(spark, sf), s), s.cover * s.expand_radius)


def _drawing(spark: SparkSession, sf: str):
    from .plans.lifecycle import Drawing

    return Drawing(src.pts_ds(spark, sf), _settings(postpone_intersections=False)).compute()


@query()
def dilate_area(spark: SparkSession, sf: str) -> DataFrame:
    from .operators.metrics import dilated_areas

    d = _drawing(spark, sf)
    return dilated_areas(d.patterns, d.points, d.settings)


@query()
def metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    return _drawing(spark, sf).report()


@query()
def stacking_order(spark: SparkSession, sf: str) -> DataFrame:
    return _drawing(spark, sf).order(outlines=False)


@query()
def stacking_relations(spark: SparkSession, sf: str) -> DataFrame:
    return _drawing(spark, sf).relations()


@query()
def svg_drawing(spark: SparkSession, sf: str) -> DataFrame:
    return _drawing(spark, sf).draw()


@query()
def greedy_forest(spark: SparkSession, sf: str) -> DataFrame:
    return skeleton.forest(skeleton.beta_skeleton(src.pts_ds(spark, sf), keys=("dataset_id",)))


@query()
def augmented_forest(spark: SparkSession, sf: str) -> DataFrame:
    return skeleton.forest(skeleton.beta_skeleton(src.pts_ds(spark, sf), keys=("dataset_id",)), augment=True)


_GAP = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"
#: Each step stops the discs whose next event is the dataset's earliest.
DISCS = f"""WITH RECURSIVE {DS}, d AS (SELECT dataset_id, point_id, type, x, y, CASE type WHEN 0 THEN 30.0::DOUBLE ELSE 20.0::DOUBLE END AS most FROM ds WHERE type IN (0, 1)),
g AS (SELECT p.dataset_id, p.point_id AS p, q.point_id AS q, {_GAP} AS gap FROM d p JOIN d q ON p.dataset_id = q.dataset_id AND p.type <> q.type),
grow AS (SELECT dataset_id, point_id, type, most, NULL::DOUBLE AS radius, 0 AS step FROM d UNION ALL
SELECT w.dataset_id, w.point_id, w.type, w.most, CASE WHEN w.radius IS NULL AND w.due = min(w.due) OVER (PARTITION BY w.dataset_id) THEN w.due ELSE w.radius END, w.step + 1 FROM (
SELECT a.dataset_id, a.point_id, a.type, a.most, a.radius, a.step, CASE WHEN a.radius IS NULL THEN least(a.most, coalesce(min(CASE WHEN b.radius IS NULL THEN g.gap / 2 ELSE greatest(g.gap - b.radius, 0) END), a.most)) END AS due
FROM grow a LEFT JOIN g ON g.dataset_id = a.dataset_id AND g.p = a.point_id LEFT JOIN grow b ON b.dataset_id = a.dataset_id AND b.point_id = g.q GROUP BY a.dataset_id, a.point_id, a.type, a.most, a.radius, a.step) w
WHERE EXISTS (SELECT 1 FROM grow c WHERE c.radius IS NULL))
SELECT dataset_id, point_id, type, round(max(radius), 6) AS radius FROM grow GROUP BY ALL"""


@query(DISCS)
def two_color_discs(spark: SparkSession, sf: str) -> DataFrame:
    from .operators.circles import grow_discs

    return grow_discs(src.pts_ds(spark, sf), 0, 1, 30.0, 20.0).withColumn("radius", r6("radius"))


_SIGNED = f"""{INFLUENCE}, up AS (SELECT * FROM pot WHERE potential > 0), c AS (SELECT type, ix, iy, 1 AS bit FROM up UNION ALL SELECT type, ix - 1, iy, 2 FROM up UNION ALL SELECT type, ix, iy - 1, 8 FROM up UNION ALL SELECT type, ix - 1, iy - 1, 4 FROM up),
m AS (SELECT type, ix, iy, sum(bit) AS mask FROM c GROUP BY 1, 2, 3 HAVING sum(bit) < 15)"""
#: A cell's corners counter-clockwise are bits 1, 2, 4, 8 here, and edge k runs from corner k to the next. From each edge
#: with a positive first corner a contour goes to the nearest edge before it with a positive second corner.
_RINGS = f"""{_SIGNED}, k AS (SELECT *, unnest([0, 1, 2, 3]) AS k FROM m), f AS (SELECT type, ix, iy, mask, k FROM k WHERE (mask >> k) & 1 = 1 AND (mask >> ((k + 1) % 4)) & 1 = 0),
l AS (SELECT f.type, f.ix, f.iy, f.k AS a, (f.k + 4 - s.s) % 4 AS b FROM f, (VALUES (1), (2), (3)) s(s) WHERE (f.mask >> ((f.k + 4 - s.s) % 4)) & 1 = 0 AND (f.mask >> ((f.k + 5 - s.s) % 4)) & 1 = 1 QUALIFY row_number() OVER (PARTITION BY f.type, f.ix, f.iy, f.k ORDER BY s.s) = 1),
e AS (SELECT type, [ix + (a = 1)::BIGINT, iy + (a = 2)::BIGINT, (a % 2)::BIGINT] AS n, [ix + (b = 1)::BIGINT, iy + (b = 2)::BIGINT, (b % 2)::BIGINT] AS nx FROM l),
z AS (SELECT e.type, n, nx, least(coalesce(p.potential, {-_T0!r}), 1e12) AS v1, least(coalesce(q.potential, {-_T0!r}), 1e12) AS v2 FROM e LEFT JOIN pot p ON p.type = e.type AND p.ix = n[1] AND p.iy = n[2] LEFT JOIN pot q ON q.type = e.type AND q.ix = n[1] + 1 - n[3] AND q.iy = n[2] + n[3]),
w AS (SELECT type, n, nx, (n[1] + (1 - n[3]) * v1 / (v1 - v2)) * {GRID} AS x, (n[2] + n[3] * v1 / (v1 - v2)) * {GRID} AS y FROM z),
walk AS (SELECT type, n AS first, nx AS "at", 1 AS steps, x, y, 0.0::DOUBLE AS twice FROM w UNION ALL SELECT k.type, k.first, w.nx, k.steps + 1, w.x, w.y, k.twice + k.x * w.y - w.x * k.y FROM walk k JOIN w ON w.type = k.type AND w.n = k.at WHERE k.at > k.first)"""


@query(f"WITH RECURSIVE {_RINGS} SELECT k.type, array_to_string(first, ',') AS contour_id, steps AS n_corners, round(abs(twice + k.x * w.y - w.x * k.y) / 2, 4) AS area FROM walk k JOIN w ON w.type = k.type AND w.n = k.first WHERE k.at = k.first")
def potential_contours(spark: SparkSession, sf: str) -> DataFrame:
    """Contours of all types with their corners and areas; the SQL walks along each from its least edge."""
    from .operators.contours import zero_contours

    return zero_contours(src.pts(spark, sf), step=fields.STEP).select("type", "contour_id", F.size("ring").alias("n_corners"), F.round("area", 4).alias("area"))


@query(f"""WITH RECURSIVE {_RINGS}, lead AS (SELECT type, first FROM walk WHERE walk.at = walk.first), seg AS (SELECT k.type, k.first, k.x, k.y, w.x AS x2, w.y AS y2 FROM walk k JOIN lead ON lead.type = k.type AND lead.first = k.first JOIN w ON w.type = k.type AND w.n = k.at)
SELECT s.type, array_to_string(s.first, ',') AS contour_id, p.point_id FROM seg s JOIN pts p ON p.type = s.type WHERE (s.y > p.y) <> (s.y2 > p.y) AND p.x < s.x + (s.x2 - s.x) * (p.y - s.y) / (s.y2 - s.y) GROUP BY s.type, s.first, p.point_id HAVING count(*) % 2 = 1""")
def potential_members(spark: SparkSession, sf: str) -> DataFrame:
    from .operators.contours import contour_members, zero_contours

    p = src.pts(spark, sf)
    return contour_members(p, zero_contours(p, step=fields.STEP))


@query(f"WITH {GHULL}, d AS (SELECT v.point_id, e.g, {_TO_EDGE} AS d FROM pts v, he e), m AS (SELECT point_id, min(d) AS d FROM d GROUP BY 1) SELECT m.point_id, min(d.g) AS g, round(m.d, 6) AS d FROM m JOIN d ON d.point_id = m.point_id AND d.d <= m.d + 1e-9 GROUP BY m.point_id, m.d")
def drawing_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The hull, of all types of all datasets, whose outline is nearest to each point."""
    from .operators.lookups import nearest

    at = src.pts(spark, sf).select(F.col("point_id").alias("place_id"), "x", "y")
    return nearest(at, _hulls(spark, sf), "g").select(F.col("place_id").alias("point_id"), F.col("ring_id").alias("g"), r6("d").alias("d"))


@query(f"""WITH {BOXES}, v AS (SELECT dataset_id, type, unnest([x0, x1]) AS x, y0 AS lo, y1 AS hi FROM rb), h AS (SELECT dataset_id, type, unnest([y0, y1]) AS y, x0 AS lo, x1 AS hi FROM rb),
c AS (SELECT v.dataset_id, v.type AS a, h.type AS b, v.x, h.y FROM v JOIN h ON v.dataset_id = h.dataset_id AND v.type <> h.type AND v.x >= h.lo AND v.x <= h.hi AND h.y >= v.lo AND h.y <= v.hi)
SELECT dataset_id, CASE WHEN a % 2 = 0 THEN a ELSE b END AS asked_id, CASE WHEN a % 2 = 0 THEN b ELSE a END AS ring_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM c WHERE a % 2 <> b % 2""")
def drawing_intersections(spark: SparkSession, sf: str) -> DataFrame:
    """Where the boxes of even types meet those of odd ones."""
    from .operators.lookups import intersections

    b = _boxes(spark, sf).select("dataset_id", F.col("type").alias("ring_id"), _box_ring().alias("ring"))
    met = intersections(b.where("ring_id % 2 = 0"), b.where("ring_id % 2 = 1"), merge=0.0)
    return met.select("dataset_id", "asked_id", "ring_id", r6("x").alias("x"), r6("y").alias("y"))
