"""Operators' cores against plain row-by-row versions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.llm import language_id, mixing, nearest, quality_classifier, quality_rules, sharding, textscan, token_counts
from pointweave.llm.queries import ORACLE_SQL, QUERIES

from .helpers import AWKWARD

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, sf_dir).toPandas(), c.execute(ORACLE_SQL[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    same = lambda v: None if v is None or v != v else v if isinstance(v, str) else float(v)
    plain = lambda d: sorted((tuple(map(same, r)) for r in d[cols].values.tolist()), key=str)
    assert plain(mine) == plain(theirs)


def test_collisions_are_those_in_the_windows():
    r = np.random.default_rng(3)
    x, q = r.normal(size=(700, 12)), r.normal(size=(25, 12))
    index = nearest.LineIndex(x, 40)
    lift = np.sqrt(np.maximum(index.norm**2 - (x * x).sum(axis=1), 0))
    at = np.column_stack([x, lift]) @ index.axes
    asked = q * (index.norm / np.linalg.norm(q, axis=1))[:, None] @ index.axes[:-1]
    for k, hit in enumerate(index.candidates(q, 30, 0.8, 0.5, 1.1)):
        for level in range(100):
            half = 0.5 * index.spread * 1.1**level
            want = np.flatnonzero((np.abs(at - asked[k]) <= half).sum(axis=1) >= 32)
            if len(want) >= 30:
                break
        assert hit.tolist() == want.tolist()
    few = nearest.LineIndex(x[:5], 40)
    assert [len(h) for h in few.candidates(q, 30, 0.8, 0.5, 1.1)] == [5] * 25


def test_search_of_vectors_of_several_lengths(spark):
    rows = [(20 * i, [float(i), 1.0]) for i in range(1, 4)] + [(20 * i + 1, [1.0, float(i), 2.0]) for i in range(1, 4)] + [(100, [0.5, 0.5, 1.0])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r["vec_id"])
    assert by == {20: [60, 40], 40: [60, 20], 60: [40, 20], 100: [61, 41, 21]}


def test_trie_shares_prefixes_across_batches(sf_dir):
    path = str(public_tokenizers.path(token_counts.VOCABULARY))
    scores, byte, longest = token_counts.vocabulary(path)

    def best(word):
        m, b = token_counts.MARK + word, [(0.0, 0)]
        for e in range(1, len(m) + 1):
            n = len(m[e - 1].encode())
            b.append(max([(b[e - 1][0] + n * byte, b[e - 1][1] - n)] + [(b[k][0] + scores[m[k:e]], b[k][1] - 1) for k in range(max(0, e - longest), e) if m[k:e] in scores]))
        return b[-1]

    counter = token_counts.TrieCounter(path)
    counter.texts(["internationalisation"])
    before = counter.computed
    counter.texts(["internationalisations intern"])
    assert counter.computed == before + 1  # one node more; all others were there
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist() + [r[1] or "" for r in AWKWARD]
    seen: dict = {}
    for small in (token_counts.TrieCounter(path, nodes=2000), counter):
        for lo in range(0, len(texts), 40):
            n, tokens, score = small.texts(texts[lo : lo + 40])
            for i, t in enumerate(texts[lo : lo + 40]):
                want = [seen.setdefault(w, None) or seen.update({w: best(w)}) or seen[w] for w in t.split()]
                assert (n[i], tokens[i]) == (len(want), -sum(w[1] for w in want))
                assert score[i] == pytest.approx(sum(w[0] for w in want))


def test_trees_against_a_walk(spark, sf_dir):
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.train(docs, marks)
    rows = quality_rules.document_statistics(docs).toPandas()
    kept = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, model).collect()}

    def walk(x):
        total = model.start
        for node in model.roots:
            while model.feature[node] >= 0:
                node = model.left[node] + int(x[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        return 1 / (1 + math.exp(-total))

    for r in rows.to_dict("records"):
        score = walk(r["features"])
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        got = kept[r["doc_id"]]
        assert got["score"] == pytest.approx(score) and got["base_failed"] == failed
        assert got["kept"] == (not failed and score >= 0.5) or abs(score - 0.5) < 1e-9


def test_rules_held_out(spark):
    """Trees that learn from some labelled documents keep good ones and drop bad ones among the others."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality_classifier.held_out(F.col("doc_id"))
    found = quality_rules.apply_rules(docs, quality_rules.train(docs, marks.where(~held))).join(marks.where(held), "doc_id").toPandas()
    some = found[~found["base_failed"]]
    assert some[some["quality"] == 1]["kept"].mean() > 0.9
    assert (some["kept"] == (some["quality"] == 1)).mean() > max(some["quality"].mean(), 1 - some["quality"].mean()) - 0.02


def test_compression_scores_against_plain(spark, sf_dir):
    import zstandard

    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, marks)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in quality_classifier.classify(docs, model).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        sizes = []
        for d in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) if d else zstandard.ZstdCompressor(level=1, write_content_size=False)
            sizes.append(sum(len(c.compress(raw[k : k + 1024])) for k in range(0, len(raw), 1024)))
        a, b = sizes
        f = ((b - a) / (a + b) if a + b else 0.0, min(a, b) / len(raw) if raw else 1.0, math.log1p(len(raw)))
        short = 1 / (1 + f[2])
        z = model.weights @ np.array([1.0, 10 * f[0], 10 * max(0.3 - f[1], 0), short, 10 * f[0] * short])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.7)


def test_all_of_a_dictionary_text_counts(spark):
    """What stands late in a long labelled text gets into the dictionary."""
    r = np.random.default_rng(0)
    filler = lambda k: " ".join(f"{'abcdef'[k % 6]}{i}" for i in r.integers(0, 10**9, 3000))
    rows = [(i, filler(i) + (" zebra quagga okapi gnu " * 12 if i % 2 else " iron zinc cobalt tin " * 12)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality_classifier.train(docs, marks, held=lambda c: F.lit(False))
    assert b"zebra quagga" in model.good and b"zinc cobalt" in model.bad


def test_gram_scores_against_plain(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("abc abd abc", "x"), ("xyz xyw abc", "y"), ("abc", "x"), ("xyz", "y")] * 3)], "doc_id long, text string, lang string")
    model = language_id.train(docs, held=lambda c: F.lit(False))
    counts = {lang: Counter() for lang in "xy"}
    for r in docs.collect():
        for w in r["text"].split():
            counts[r["lang"]].update([f"^{w}$"[i : i + k] for k in (2, 3) for i in range(len(w) + 3 - k)] + ["=" + w])
    for lang in counts:
        counts[lang] = {g: n for g, n in counts[lang].items() if n > 1}
    grams = sorted({g for c in counts.values() for g in c})
    total = {lang: sum(c.values()) + 0.5 * (len(grams) + 1) for lang, c in counts.items()}
    for g in grams:
        log = {lang: math.log((c.get(g, 0) + 0.5) / total[lang]) for lang, c in counts.items()}
        mean = sum(log.values()) / 2
        assert model.scores[model.grams[g]].tolist() == pytest.approx([log[lang] - mean for lang in model.languages], abs=1e-5)


def test_expected_copies_are_the_fraction(spark):
    """Over many seeds a document of any size is taken its source's fraction of times."""
    sizes = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89] * 6
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n long")
    item = docs.select(F.struct(F.struct("doc_id", F.col("n").alias("size"), F.lit(0).cast("long").alias("copy_no")).alias("id"), F.col("n").cast("double").alias("size"), F.lit(0.3).alias("x")).alias("item"))
    items = item.agg(F.array_sort(F.collect_list("item")).alias("items")).cache()
    taken, runs = Counter(), 150
    for lo in range(0, runs, 50):
        seeds = spark.range(lo, lo + 50, numPartitions=4).select(F.col("id").alias("seed"))
        # The seed is part of each document's identity here, so every run draws other numbers.
        many = seeds.crossJoin(items).select("seed", F.transform("items", lambda x: F.struct(F.struct(x["id"]["doc_id"].alias("doc_id"), x["id"]["size"].alias("size"), F.col("seed").alias("copy_no")).alias("id"), x["size"].alias("size"), x["x"].alias("x"))).alias("items"))
        rows = many.select(mixing._fold(F.col("items"), 5).alias("r")).select("r.open", "r.done").collect()
        for row in rows:
            for d in row["done"]:
                taken[d["id"]["doc_id"]] += d["take"]
            if row["open"] is not None:
                taken[row["open"]["id"]["doc_id"]] += row["open"]["x"]
    for n in set(sizes):
        own = [taken[i] / runs for i, s in enumerate(sizes) if s == n]
        assert np.mean(own) == pytest.approx(0.3, abs=0.07), n
    assert sum(taken[i] * s for i, s in enumerate(sizes)) == pytest.approx(0.3 * sum(sizes) * runs)


def test_slot_map_growth(spark):
    rows = QUERIES["slot_map_growth"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["vslot"] for r in rows) == list(range(sharding.SLOTS))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)
    empty = [r for r in rows if not r["bytes"]]
    per = Counter(r["shard"] for r in empty)
    assert len(per) > 30  # slots without records are dealt out, too
    load = Counter()
    for r in rows:
        load[r["grown_shard"]] += r["bytes"]
    fair = sum(load.values()) / 41
    old = Counter()
    for r in rows:
        old[r["shard"]] += r["bytes"]
    assert all(load[k] == old[k] or load[k] >= fair for k in range(40)) and load[40] > 0.5 * fair
    assert sum(r["grown_shard"] == 40 for r in empty) > 0.5 * len(empty) / 41


def test_map_against_plain_greedy(spark):
    r = np.random.default_rng(1)
    weights = [(int(s), int(b)) for s, b in enumerate(r.integers(0, 50, 300))]
    put = {x["vslot"]: x["shard"] for x in sharding.new_map(spark.createDataFrame(weights, "vslot int, bytes long"), 7).collect()}
    load, want = [0] * 7, {}
    for s, b in sorted(weights, key=lambda w: (-max(w[1], 1), w[0])):
        k = min(range(7), key=lambda k: (load[k], k))
        want[s], load[k] = k, load[k] + max(b, 1)
    assert put == want


@pytest.mark.parametrize("length", [70_000, 700_000])
def test_a_long_text_is_scanned_in_pieces(length):
    import pyarrow as pa

    r = np.random.default_rng(0)
    words = [f"w{i}" for i in r.integers(0, 50_000, length // 6)] + ["x" * (3 * textscan.HASHED + 17)] * 2
    text = " ".join(words)
    whole, single = textscan.Scan(pa.array(["ab", text, None])), textscan.Scan(pa.array([words[0], words[-1], words[7]]))
    h = whole.word_hashes()
    assert len(h) == len(words) + 1 and [h[1], h[-1], h[8]] == single.word_hashes().tolist() and h[-1] == h[-2]
    assert len(set(h.tolist())) == len({"ab", *words})
