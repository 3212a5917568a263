"""Texts of near duplicates are dropped before they are shuffled."""

from pyspark.sql import functions as F

from pointweave.llm import base, near_duplicates


def test_only_texts_of_shared_buckets_are_shuffled(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(3000)]
    rows += [(9000 + i, t + " end") for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = docs.where("doc_id < 20 or doc_id >= 9000").select(near_duplicates.content_key(F.col("text")).alias("key"))
    left = near_duplicates.sifted(docs.withColumn("key", near_duplicates.content_key(F.col("text"))), keys, "key")
    ids = {r["doc_id"] for r in left.collect()}
    assert left.columns == ["doc_id", "text", "key"]
    assert {i for i, _ in rows if i < 20 or i >= 9000} <= ids and len(ids) < 400
    assert near_duplicates.sifted(docs.withColumn("key", F.lit(b"x")), keys.where("false"), "key").isEmpty()

    plans, write = {}, base.Scratch.write

    def seen(self, df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, df, tag)

    monkeypatch.setattr(base.Scratch, "write", seen)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(docs).collect()}
    assert got == {i: i - 9000 if i >= 9000 else i for i, _ in rows}
    assert "bitmap_construct_agg" in plans["dup-texts"]
