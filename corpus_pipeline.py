"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents as they
are, whatever their names. A null text counts as empty and, as it has no words, doesn't pass the rules. Null and repeated
ids are rows of their own until near duplicates, which keep one row of equal texts. Texts of any length are taken whole.
An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointweave.llm import quality_classifier, quality_rules
from pointweave.llm.base import Scratch, table
from pointweave.llm.mixing import mixed_documents
from pointweave.llm.near_duplicates import deduplicate
from pointweave.llm.packing import pack


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier finds good (9)."""
    return quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")), columns=True)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees (8). The trees learn from labelled documents of the whole
    table, as those that the classifier kept are no fair sample.
    """
    model = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, model, columns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (2): the one of the least doc_id."""
    return deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (4)."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences (3)."""
    return pack(docs)


STAGES = [("quality classifier", classify), ("quality rules", rules), ("near duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: Compression, boosted trees, signatures, random rounding and tokenizers aren't expressible in SQL: tests compare the
#: stages with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)  # nothing reads it any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
