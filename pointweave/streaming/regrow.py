"""Points that arrive in batches: the datasets that a batch touches are grown anew.

Growth can't go on from an earlier history, as a new point may forbid an earlier merge, so a touched dataset is read
whole. Each batch writes its datasets' histories under its own number; a batch that is repeated after a failure
overwrites the same files, and the newest number of a dataset counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.growth import grow
from ..settings import Settings


def regrow(stream: DataFrame, points_path: str, history_path: str, checkpoint: str, settings: Settings) -> StreamingQuery:
    """stream: (dataset_id, point_id, type, x, y). Runs through what is there, then ends."""

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        new.write.mode("overwrite").parquet(f"{points_path}/batch={number}")
        touched = new.select("dataset_id").distinct()
        whole = spark.read.parquet(points_path).drop("batch").join(touched, "dataset_id", "left_semi")
        grow(whole, settings).write.mode("overwrite").parquet(f"{history_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, history_path: str) -> DataFrame:
    """Each dataset's newest history."""
    h = spark.read.parquet(history_path)
    newest = F.max("batch").over(Window.partitionBy("dataset_id"))
    return h.withColumn("__n", newest).where("batch = __n").drop("__n", "batch")
