"""Point sources: tables, text lines and drawing marks, as (point_id, type, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.planar import affine, decimal_text
from ..settings import EXTENSIONS, Settings, good_settings

# Mark colour names and their types.
COLOR_TYPES = {
    "CB light blue": 0,
    "CB light red": 1,
    "CB light green": 2,
    "CB light orange": 3,
    "CB light purple": 4,
    "CB yellow": 5,
    "CB brown": 6,
    "CART 1": 0,
    "CART 2": 1,
    "CART 3": 2,
    "CART 4": 3,
    "CART 5": 4,
    "CART 6": 5,
    "CART 7": 6,
    "CART 8": 7,
    "CART 9": 8,
    "CART 10": 9,
    "CART 11": 10,
    "CART 12": 11,
}
FIRST_UNKNOWN_TYPE = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' first two components as points of the embedding's label."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").alias("type"), (1000 * e[0].cast("double")).alias("x"), (1000 * e[1].cast("double")).alias("y"))


def pts_ds(spark: SparkSession, sf_dir: str, datasets: int = 10) -> DataFrame:
    return pts(spark, sf_dir).select((F.col("point_id") % datasets).alias("dataset_id"), "*")


def event_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), F.col("event_type").alias("type"), F.col("value").alias("x"), F.hour("ts").cast("double").alias("y"))


def account_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_nationkey").alias("type"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))


def format_points(points: DataFrame) -> DataFrame:
    """(point_id, line): `type x y` with three decimals."""
    return points.select("point_id", F.concat_ws(" ", F.col("type").cast("string"), decimal_text(F.col("x")), decimal_text(F.col("y"))).alias("line"))


def parse_points(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """(..., point_id, line) -> points. Empty lines are skipped, words after the third ignored.

    FAILFAST raises on a malformed line; PERMISSIVE drops it.
    """
    cast = (lambda c, t: c.try_cast(t)) if mode == "PERMISSIVE" else (lambda c, t: c.cast(t))
    word = F.split("line", " ")
    keys = [c for c in lines.columns if c != "line"]
    parsed = lines.where("line != ''").select(*keys, cast(F.get(word, F.lit(0)), "int").alias("type"), cast(F.get(word, F.lit(1)), "double").alias("x"), cast(F.get(word, F.lit(2)), "double").alias("y"))
    return parsed.dropna() if mode == "PERMISSIVE" else parsed


def read_text_points(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Files of text lines: dataset (the file), point_id (the line's place in its file, from 0), type, x, y.

    Large files are read in splits. Lines are numbered within their split; a running sum over a file's splits, of which
    there are few, gives where each begins.
    """
    at = F.col("_metadata")
    lines = spark.read.text(path).select(at["file_path"].alias("dataset"), at["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__i"), F.regexp_replace("value", "\r$", "").alias("line"))
    inside = lines.withColumn("__k", F.row_number().over(Window.partitionBy("dataset", "__block").orderBy("__i")) - 1)
    blocks = lines.groupBy("dataset", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("dataset").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = inside.join(starts, ["dataset", "__block"]).select("dataset", (F.col("__start") + F.col("__k")).cast("long").alias("point_id"), "line")
    return parse_points(numbered, mode)


def category_types(marks: DataFrame, fill: str = "fill", order: str = "point_id", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Add `type`: known colour names have fixed ones, unknown names the next from 7 in order of first appearance (in
    each drawing, if `by` names it). Only the different unknown names of a drawing are numbered in one task.
    """
    known = F.create_map(*[F.lit(v) for item in COLOR_TYPES.items() for v in item])
    marks = marks.withColumn("__known", F.try_element_at(known, F.col(fill)))
    new = marks.where("__known is null").groupBy(*by, fill).agg(F.min(order).alias("__first"))
    new = new.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(fill).alias("__fill"), (F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__first")) - 1 + FIRST_UNKNOWN_TYPE).alias("__new"))
    on = F.col(fill) == F.col("__fill")
    for c in by:
        on &= F.col(c) == F.col(f"__{c}")
    return marks.join(new, on, "left").withColumn("type", F.coalesce("__known", "__new").cast("int")).drop("__known", "__fill", "__new", *[f"__{c}" for c in by])


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, f'[ ]{name}="([^"]*)"', 1)
    return F.when(found != "", found)


def ipe_points(files: DataFrame, content: str = "value") -> DataFrame:
    """Marks (`<use .../>`) of drawing files, in document order; a missing matrix is the identity. `dataset` stays, if
    files have it.
    """
    keys = [c for c in ("dataset",) if c in files.columns]
    tags = files.select(*keys, F.posexplode(F.regexp_extract_all(F.col(content), F.lit("(<use [^>]*>)"), F.lit(1))).alias("point_id", "tag"))
    pos = F.split(_attribute(F.col("tag"), "pos"), " ")
    m = F.split(F.coalesce(_attribute(F.col("tag"), "matrix"), F.lit("1 0 0 1 0 0")), " ")
    number = lambda c, i: F.get(c, F.lit(i)).cast("double")
    raw = tags.select(*keys, F.col("point_id").cast("long").alias("point_id"), _attribute(F.col("tag"), "fill").alias("fill"), *[number(pos, i).alias(f"p{i}") for i in range(2)], *[number(m, i).alias(f"m{i}") for i in range(6)])
    x, y = affine(F.col("p0"), F.col("p1"), tuple(F.col(f"m{i}") for i in range(6)))
    return category_types(raw.withColumn("x", x).withColumn("y", y), by=keys).select(*keys, "point_id", "type", "x", "y")


def ipe_regions(files: DataFrame, content: str = "value") -> DataFrame:
    """Polygons (`<path>` with m, l and h lines): region_id, color (fill or else stroke), ring, closed; `dataset` stays, if
    files have it.
    """
    keys = [c for c in ("dataset",) if c in files.columns]
    paths = files.select(*keys, F.posexplode(F.regexp_extract_all(F.col(content), F.lit("(<path [^>]*>[^<]*</path>)"), F.lit(1))).alias("region_id", "tag"))
    lines = F.transform(F.split(F.regexp_extract("tag", ">([^<]*)<", 1), "\n"), lambda s: F.split(F.trim(s), " "))
    steps = F.filter(lines, lambda w: (F.size(w) == 3) & F.get(w, F.lit(2)).isin("m", "l"))
    ring = F.transform(steps, lambda w: F.struct(w[0].cast("double").alias("x"), w[1].cast("double").alias("y")))
    closed = F.exists(lines, lambda w: w[0] == "h")
    return paths.select(*keys, F.col("region_id").cast("long").alias("region_id"), F.coalesce(_attribute(F.col("tag"), "fill"), _attribute(F.col("tag"), "stroke")).alias("color"), ring.alias("ring"), closed.alias("closed"))


def read_points(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """A drawing (.ipe) or text lines (any other name)."""
    if path.endswith(".ipe"):
        return ipe_points(spark.read.text(path, wholetext=True).withColumn("dataset", F.col("_metadata.file_path")))
    return read_text_points(spark, path, mode)


def load_example(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, Settings]:
    """An example dataset of the catalogue from a folder that holds its file, with its recommended settings."""
    return read_points(spark, f"{folder}/{name}.{EXTENSIONS.get(name, 'ipe')}"), good_settings(name)


def save_points(points: DataFrame, path: str, by: str = "dataset_id") -> None:
    """One folder of text lines `type x y` for each value of `by`, in order of point_id."""
    lines = points.select(by, "point_id", F.concat_ws(" ", F.col("type").cast("string"), decimal_text(F.col("x")), decimal_text(F.col("y"))).alias("line"))
    lines.repartition(by).sortWithinPartitions(by, "point_id").select(by, "line").write.mode("overwrite").partitionBy(by).text(path)


def place(points: DataFrame, added: DataFrame) -> DataFrame:
    """Points appended after the last, numbered on."""
    last = points.agg(F.coalesce(F.max("point_id"), F.lit(-1)).alias("__last"))
    order = Window.orderBy("point_id")
    new = added.crossJoin(F.broadcast(last)).withColumn("point_id", F.col("__last") + F.row_number().over(order)).drop("__last")
    return points.unionByName(new)


def move(points: DataFrame, point_id: int, x: float, y: float) -> DataFrame:
    from ..functions.planar import round_half_up

    hit = F.col("point_id") == point_id
    return points.withColumn("x", F.when(hit, round_half_up(F.lit(x))).otherwise(F.col("x"))).withColumn("y", F.when(hit, round_half_up(F.lit(y))).otherwise(F.col("y")))


def remove(points: DataFrame, point_id: int) -> DataFrame:
    return points.where(F.col("point_id") != point_id)
