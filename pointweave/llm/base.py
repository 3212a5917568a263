"""What the training-data operators share: tables, written intermediate results, row keys, a worker's memory."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a row group in intermediate tables (128 MB otherwise, for each task that reads and each that writes).
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a session within one process may leave it unnamed."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pointweave-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no rework before it.

    A task that writes holds a row group in its heap, and so does one that reads it, whatever its share of the table is.
    """
    path = path or new_path(df.sparkSession, tag)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written intermediate tables of one run. drop() deletes those that nothing reads any more; what a returned result
    still reads stays in the shared folder, as it is read after the operator has returned.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_path(self.spark, tag)
        out = materialize(df, tag, path)
        self.paths[id(out)] = (out, path)  # holding it keeps its id from being used again
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, self.paths.pop(id(t))[1])


_kept: dict = {}


def worker_memory(name: tuple, make=None):
    """What a Python worker keeps from task to task: one operator's at a time, as a worker serves stage after stage.

    Without `make`, what others kept is dropped. Whoever comes next gives freed memory back to the machine.
    """
    if name not in _kept:
        _kept.clear()
        give_back()
        if make is not None:
            _kept[name] = make()
    return _kept.get(name)


def give_back() -> None:
    """Freed memory returns to the machine; the C library would keep it for this process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def distinct_rows(df: DataFrame, keys: list[str], copy: str = "copy_no", most: int = 1 << 16) -> DataFrame:
    """The rows' keys, and a number that tells equal rows apart (0, 1, ...).

    Equal rows are counted before the shuffle, so a row that makes up a third of the table is one row of the
    aggregate; the number makes any hash of (keys, copy_no) spread such copies and makes reruns agree. Rows that stand
    more than `most` times are dealt out in blocks of so many, so no task makes all of them.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    numbers = lambda lo, hi: F.explode(F.sequence(lo, hi - 1)).alias(copy)
    few = counted.where(F.col("__n") <= most).select(*keys, numbers(F.lit(0).cast("long"), F.col("__n")))
    blocks = counted.where(F.col("__n") > most).select(*keys, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(most).cast("long"))).alias("__lo"))
    many = blocks.repartition(*keys, "__lo").select(*keys, numbers(F.col("__lo"), F.least(F.col("__lo") + most, "__n")))
    return few.unionByName(many)


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the columns' values."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
