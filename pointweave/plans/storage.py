"""Where intermediate tables go, and how groups are dealt out."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's folder. Only a session within one process may leave the folder unnamed."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.partition("[")[0] != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pointweave-"))
    return df.checkpoint()


def side_by_side(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key for kernels that run group by group.

    Such groups are small but take long, so adaptive execution, which goes by bytes, would put all of them in one task;
    a number of partitions that is named stays.
    """
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
