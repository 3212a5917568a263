"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

LONG = "word " * 30_000 + "end"
AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "b"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (None, "no id here but some words to count", "en", "a"),
    (None, "no id here but some words to count", "en", "a"),
    (4, " \t\n ", None, "a"),
    (5, LONG, "en", "b"),
    (6, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", None),
    (6, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", None),
    (7, "*** 12 \u00b2 _", "fr", "c"),
    (8, "é́ \U0001f600 日本語 <|endoftext|>\x00\x1c", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators might use inside.
CLASHING = ["n", "h", "key", "size", "id", "rank", "k", "v", "c", "part", "__id", "__n", "bands", "score", "kept", "copies", "slot"]


def awkward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.select("*", F.lit(None).cast("long").alias("n_chars"), *[F.lit(7).alias(c) for c in CLASHING])


def empty(spark):
    return awkward(spark).where("false")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 0, 0), (6, 1, 0), (None, 1, None), (9, None, None)], "doc_id long, quality int, toxic int")


def no_labels(spark):
    return labels(spark).where("false")
