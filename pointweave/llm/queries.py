"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_classifier, quality_rules
from .base import WORD, new_path, table
from .collocations import phrases
from .mixing import mix, targets, word_count
from .near_duplicates import classes
from .nearest import search
from .packing import pack
from .periodic_runs import find_runs
from .sharding import load_map, rebalance, record_size, save_map, shard
from .token_counts import count_tokens
from .token_store import round_trip
from .url_filter import ALLOW, BLOCK, judge

#: Fixed values of op11: host, path, verdict.
URL_RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]

#: Encoded pieces that a worker of op3 and op7 keeps: about 200 MB of its memory.
PIECES = 1_000_000


def op1_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_dart_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op3_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), memory=PIECES)


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copy_no")


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = shard(table(spark, sf_dir, "documents"), shards=40)
    return records.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op6_viterbi_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op7_plane_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), memory=PIECES)


def op8_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op9_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op10_collision_counting_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op11_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that no rule fits are allowed."""
    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: texts of which every tenth repeats a stretch of its words to its end, as op13 has it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    n = F.size("w").cast("long")
    g = F.floor(F.col("h") / 10)
    at = words.where("size(w) > 0").select("doc_id", "w", n.alias("n"), (g % n).alias("a"), g.alias("g"))
    at = at.withColumn("rest", F.col("n") - F.col("a")).withColumn("p", F.lit(1) + F.floor(F.col("rest") / (F.lit(3) + F.col("g") % 8)))
    block = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.col("rest").cast("int"))
    changed = at.select("doc_id", F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ").alias("text"))
    return words.where("not coalesce(size(w) > 0, false)").select("doc_id", "text").unionByName(changed)


def op13_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(_with_planted_runs(table(spark, sf_dir, "documents")))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size, its source's, and its source's target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    goal = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"))).select(F.col("source").alias("s"), "source_size", F.round("target", 4).alias("target"))
    return docs.join(F.broadcast(goal), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target")


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's base statistics and whether it fails the base rules."""
    return quality_rules.document_statistics(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.BASE, (F.expr(f"n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words")).alias("base_failed"))


def record_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size as a record of a shard."""
    return table(spark, sf_dir, "documents").select("doc_id", record_size(F.col("text")).alias("size"))


def slot_map_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of 40 shards stored as version 1, that of 41 as version 2: vslot, bytes, shard, grown_shard."""
    path = new_path(spark, "slot-map")
    _, put = shard(table(spark, sf_dir, "documents"), shards=40, path=path)
    save_map(rebalance(put, 41), path)
    return load_map(spark, path, 1).join(load_map(spark, path).select("vslot", F.col("shard").alias("grown_shard")), "vslot").select("vslot", "bytes", "shard", "grown_shard")


#: The opN_ queries, one an operator; then parts of them that SQL can state, and how a slot map grows.
QUERIES = {
    f.__name__: f
    for f in (
        op1_trie_token_counts,
        op2_dart_near_duplicates,
        op3_cutting_stock_packing,
        op4_pivotal_mixing,
        op5_virtual_slots,
        op6_viterbi_language_id,
        op7_plane_store,
        op8_boosted_rules,
        op9_compression_classifier,
        op10_collision_counting_search,
        op11_url_trie,
        op12_phrase_collocations,
        op13_suffix_tree_runs,
        mixing_targets,
        rule_statistics,
        record_sizes,
        slot_map_growth,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_RAISED = "sum(cap) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE_SQL: dict[str, str] = {
    "op11_url_trie": f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS i FROM u),
r(h, start, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
m AS (SELECT i, arg_max(h || start, length(h) * 1000000 + length(start)) AS rule, arg_max(v, length(h) * 1000000 + length(start)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (i)""",
    "op12_phrase_collocations": rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_AZ}) AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, w[k : k + m - 1] AS g, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM w, range(1, 6) AS r(m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 100),
i AS (SELECT DISTINCT lang, g[k : k + s - 1] AS g, f FROM (SELECT lang, m, g, f, s, unnest(range(1, m - s + 2)) AS k FROM g, range(2, 5) AS r(s) WHERE s < m)),
x AS (SELECT lang, g, max(f) AS f FROM i GROUP BY ALL),
c AS (SELECT g.lang, g.g, g.m, g.f AS a FROM g LEFT JOIN x ON x.lang = g.lang AND x.g = g.g WHERE g.m > 1 AND NOT coalesce(100 * x.f >= 100 * g.f, false)),
s AS (SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, t.n, (1000 * c.a::HUGEINT * t.n) // (l.f::HUGEINT * r.f) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN g l ON l.lang = c.lang AND l.g = c.g[1 : k] JOIN g r ON r.lang = c.lang AND r.g = c.g[k + 1 : c.m] JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM b)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o QUALIFY rank <= 2000""",
    "mixing_targets": f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][k % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / [5.0, 2.0, 1.0][k % 3 + 1]::DOUBLE AS ratio FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce({_RAISED}, 0)) / sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w), r AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level < ratio)
SELECT d.doc_id, d.size, w.source_size, round(least(w.cap, coalesce(r.level * w.w, w.cap)), 4) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, r""",
    "rule_statistics": f"""WITH d AS (SELECT doc_id, row_number() OVER () AS i, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT i, k, array_to_string(w[k : k + 7], ' ') AS g FROM (SELECT i, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) > 7)), h AS (SELECT i, k, count(*) OVER (PARTITION BY i, g) AS n FROM g),
c AS (SELECT i, count(DISTINCT place) AS n FROM (SELECT i, unnest(range(k, k + 8)) AS place FROM h WHERE n > 1) GROUP BY i),
l AS (SELECT i, count(*) - count(DISTINCT line) AS n FROM (SELECT i, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY i),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN l ON l.i = d.i LEFT JOIN c ON c.i = d.i)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b""",
    "record_sizes": "SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size FROM documents",
}
