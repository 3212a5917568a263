"""Sharding by fixed virtual slots, with DataFrame functions only.

A record's slot is a hash of its key into a fixed number of slots. Bytes are summed for each slot, and a small map
tells the shard of each slot. Rebalancing edits the map, never the slots: only the records of moved slots move.
The map is a table with a version, so readers can stay on the version that they started with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import distinct_rows, materialize, new_path

SLOTS = 4096
OVERHEAD = 16


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, size, ...) -> one row for each slot, whether it has records or not: vslot, bytes, rows."""
    some = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(F.broadcast(some), "vslot", "left").select("vslot", zero("bytes"), zero("rows"))


def save_map(put: DataFrame, path: str) -> None:
    """Add a new version of a map to the table at path. Readers stay on the version that they started with."""
    one = put.select("version", "vslot", "shard", "bytes", F.col("version").alias("map_version")).coalesce(1)
    one.write.mode("append").partitionBy("map_version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map at path, by default the newest."""
    every = spark.read.parquet(path).drop("map_version")
    at = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == at)


def new_map(weights: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """Slot weights -> (version, vslot, shard, bytes): the heaviest slot first, each to the shard with the fewest bytes.

    The slots' number is fixed, so this one-row fold is of fixed size whatever the data. Ties go to the smaller slot
    and the smaller shard; slots without records count a byte here, so they are dealt out evenly, too, and the map has
    every slot that a later record may fall into.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.greatest("bytes", F.lit(1))).alias("neg"), F.col("vslot").alias("vslot"))))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.lit(0).cast("long").alias("load"), i.cast("int").alias("shard")))
    kind = "array<struct<vslot:int,shard:int,bytes:bigint>>"

    def place(acc: Column, s: Column) -> Column:
        least = F.array_min(acc["loads"])["shard"]
        lighter = F.transform(acc["loads"], lambda x: F.struct((x["load"] + F.when(x["shard"] == least, -s["neg"]).otherwise(F.lit(0))).alias("load"), x["shard"].alias("shard")))
        return F.struct(lighter.alias("loads"), F.concat(acc["put"], F.array(F.struct(s["vslot"].alias("vslot"), least.alias("shard"), (-s["neg"]).alias("bytes")))).cast(kind).alias("put"))

    dealt = weights.agg(order.alias("slots")).select(F.aggregate("slots", F.struct(loads.alias("loads"), F.array().cast(kind).alias("put")), place)["put"].alias("put"))
    put = dealt.select(F.inline("put")).select("vslot", "shard")
    return put.join(F.broadcast(weights.select("vslot", "bytes")), "vslot").select(F.lit(version).alias("version"), "vslot", "shard", "bytes")


def rebalance(old: DataFrame, shards: int) -> DataFrame:
    """A map's next version over more shards: slots move only to the new shards, until each has its share of the bytes.

    Each old shard offers its lightest slots as long as it keeps its new fair share; offered slots go to the new shards
    in turn by running bytes. Of the slots without records the new shards get their share by hash. Other slots keep
    their shard.
    """
    every = Window.partitionBy(F.lit(0))  # the map has a fixed number of rows
    fair = F.sum("bytes").over(every) / F.lit(float(shards))
    n_old = F.max("shard").over(every) + 1
    up = Window.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0)
    left = F.sum("bytes").over(Window.partitionBy("shard")) - F.sum("bytes").over(up)
    t = old.withColumn("__fair", fair).withColumn("__old", n_old).withColumn("__full", F.col("bytes") > 0)
    t = t.withColumn("__moves", F.col("__full") & (left >= F.col("__fair")))
    run = Window.partitionBy("__moves").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(run), F.lit(0))
    to = F.least(F.col("__old") + F.floor(F.try_divide(before, F.col("__fair"))), F.lit(shards - 1))
    drawn = F.pmod(F.xxhash64("vslot"), F.lit(shards))
    shard = F.when(F.lit(shards) <= F.col("__old"), F.col("shard")).when(F.col("__moves"), to).when(~F.col("__full") & (drawn >= F.col("__old")), drawn).otherwise(F.col("shard"))
    return t.select((F.col("version") + 1).alias("version"), "vslot", shard.cast("int").alias("shard"), "bytes")


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, map): records have doc_id, size, text_crc32, vslot, shard, slot; `slot` numbers a shard's records from 0.

    The map is stored at `path`, as its version 1; by default in a folder of its own below the session's shared one.

    The key is doc_id; copies of a whole record (also null ids) are told apart by a number, so that they spread.
    Null text counts no bytes and has the checksum of the empty text. Other columns are ignored; an empty table gives
    empty results.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), record_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = distinct_rows(flat, ["doc_id", "size", "text_crc32"])
    # copy 0 hashes by id alone; what tells further copies apart only matters where rows repeat.
    rows = materialize(rows.withColumn("vslot", slot_of("doc_id", "copy_no", F.when(F.col("doc_id").isNull(), F.col("text_crc32")), slots=slots)), "shard-rows")
    per_slot = slot_bytes(rows, slots)
    path = path or new_path(docs.sparkSession, "slot-map")
    save_map(new_map(per_slot, shards), path)
    put = load_map(docs.sparkSession, path)
    starts = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_slot.select(F.col("vslot"), "rows").join(put.select("vslot", "shard"), "vslot").withColumn("__start", F.coalesce(F.sum("rows").over(starts), F.lit(0)))
    within = Window.partitionBy("vslot").orderBy("doc_id", "copy_no", "size", "text_crc32")
    numbered = rows.withColumn("__i", F.row_number().over(within) - 1)
    records = numbered.join(placed.select("vslot", "shard", "__start"), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("__start") + F.col("__i")).cast("long").alias("slot"))
    return records, put
