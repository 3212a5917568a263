"""Intermediate tables have small row groups: a task holds one in its heap, to write it and to read it."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pointweave.llm import base


def test_a_stages_table_is_written_in_small_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(base, "new_path", lambda spark, tag: f"{tmp_path}/{tag}")
    # 38 MB in one task, which hardly compress.
    docs = spark.range(0, 3000, 1, 1).withColumn("text", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda j: F.sha2(F.concat_ws("-", "id", j), 256))))
    kept = base.Scratch(spark).write(docs, "stage")
    assert kept.count() == 3000 and kept.exceptAll(docs).isEmpty()
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "stage").glob("*.parquet")]
    sizes = [m.row_group(i).column(1).total_compressed_size for m in files for i in range(m.num_row_groups)]
    assert sum(sizes) > 2 * base.ROW_GROUP
    assert max(sizes) < 1.25 * base.ROW_GROUP, sizes  # one of all rows before
