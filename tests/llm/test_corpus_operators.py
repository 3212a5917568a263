"""Near duplicates, mixing, sharding, search and the pipeline against brute force and edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.llm import mixing, near_duplicates, nearest, sharding
from pointweave.llm.queries import QUERIES

from .helpers import awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(sf_dir):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def plain_classes(ids, texts):
    sets, parent, inverted, shared = [shingles(t) for t in texts], list(range(len(texts))), defaultdict(list), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)
    for found in inverted.values():
        shared.update((a, b) for k, a in enumerate(found) for b in found[k + 1 :])
    same = defaultdict(list)
    for i, t in enumerate(texts):
        same[t or ""].append(i)
    for group in same.values():
        for i in group[1:]:
            parent[root(i)] = root(group[0])
    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            parent[root(b)] = root(a)
    out = defaultdict(list)
    for k, i in enumerate(ids):
        out[root(k)].append(i)
    return sorted(sorted(map(str, v)) for v in out.values())


def found_classes(rows, by="class_key"):
    out = defaultdict(list)
    for r in rows:
        out[bytes(r[by]) if by == "class_key" else r[by]].append(str(r["doc_id"]))
    return sorted(sorted(v) for v in out.values())


def test_near_duplicates_against_brute_force(spark, sf_dir):
    d = documents("/root/testdata/sf0.01")
    rows = QUERIES["op2_dart_near_duplicates"](spark, "/root/testdata/sf0.01").collect()
    assert found_classes(rows, "class_id") == plain_classes(d["doc_id"].tolist(), d["text"].tolist())


def test_near_duplicates_chain_and_shared_passage(spark):
    """A chain of copies of copies is one class; documents that share half of their text are none."""
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in r.integers(0, 10**6, 400)]
    rows, chain = [], list(words)
    for k in range(30):
        rows.append((k, " ".join(chain)))
        chain = list(chain)
        chain[(k * 37) % 400] = f"new{k}"
    passage = " ".join(f"p{i}" for i in range(120))
    rows += [(100 + k, passage + " " + " ".join(f"own{k}_{i}" for i in range(100))) for k in range(60)]
    found = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert found_classes(found) == plain_classes(*zip(*rows, strict=True))


@pytest.mark.parametrize("weighted", [False, True])
def test_dart_signatures_estimate_similarity(weighted):
    r = np.random.default_rng(0)
    u = r.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = u[:1000], np.concatenate([u[:700], u[1000:1300]])
    wa = r.uniform(0.2, 5, 1000) if weighted else np.ones(1000)
    wb = np.concatenate([wa[:700] * (r.uniform(0.5, 1.5, 700) if weighted else 1), np.ones(300)])
    true = np.minimum(wa[:700], wb[:700]).sum() / (np.maximum(wa[:700], wb[:700]).sum() + wa[700:].sum() + wb[700:].sum())
    sig = near_duplicates.dart_minhash(np.concatenate([a, b]), np.repeat([0, 1], 1000), np.concatenate([wa, wb]), 3, 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(true, abs=0.04)
    assert (sig[2] == 0).all() and (sig[:2] != 0).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (60, 50), (70, 70)]
    got = {r["node"]: r["component"] for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 50: 40, 60: 40}


def test_deduplicate(spark):
    docs = awkward(spark)
    kept = near_duplicates.deduplicate(docs)
    assert kept.columns == docs.columns
    # 1 and 6 are alike; the empty ones are; the rows without id are one text; white space alone is its own text
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "None", "4", "5", "7", "8"])
    before = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in before for r in kept.collect())  # every column as it was, whatever its name
    assert near_duplicates.deduplicate(empty(spark)).count() == 0
    assert near_duplicates.classes(docs).count() == docs.count()


def test_groups_that_share_buckets_but_no_component(spark):
    """Many versions of one text around the similarity: buckets are shared, few pairs are alike."""
    r = np.random.default_rng(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(120):
        own = list(base)
        for j in r.choice(300, int(r.integers(6, 16)), replace=False):
            own[j] = f"x{k}_{j}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, rows[k % 7][1]) for k in range(50)]
    found = near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=64, rows=3).collect()
    assert found_classes(found) == plain_classes(*zip(*rows, strict=True))


def test_repeated_rows_are_numbered_in_blocks(spark):
    from pointweave.llm.base import distinct_rows

    df = spark.createDataFrame([(1,)] * 10 + [(2,)] + [(None,)] * 7, "a long")
    got = sorted((r["a"] or 0, r["copy_no"]) for r in distinct_rows(df, ["a"], most=3).collect())
    assert got == [(0, k) for k in range(7)] + [(1, k) for k in range(10)] + [(2, 0)]


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, add = sum(w[s] for s in open_), left
        left = 0.0
        for s in list(open_):
            target[s] += add * w[s] / total
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def check_mix(rows, tolerance):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    want = plain_targets({s: sum(r["size"] for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert all(r["target"] == pytest.approx(want[s], abs=1e-6) and 0 <= r["taken"] <= 2 * r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - want[s]) <= tolerance(v)


def test_mixing(spark, sf_dir):
    rows = QUERIES["op4_pivotal_mixing"](spark, sf_dir).collect()
    sizes = {i: len(WORD.findall(t)) for i, t in zip(*(documents(sf_dir)[c] for c in ("doc_id", "text")), strict=True)}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    check_mix(rows, lambda v: max(r["size"] for r in v))
    again = QUERIES["op4_pivotal_mixing"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mixing_meets_targets_closely(spark):
    r = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, "w " * int(r.lognormal(4, 1.2)), "abcdefg"[min(int(r.exponential(2)), 6)]) for i in range(6000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    check_mix(rows, lambda v: 0.002 * v[0]["target"] + 20)
    fraction = {s: (t, z) for s, t, z in {(x["source"], x["target"], x["source_size"]) for x in rows}}
    for s, (t, z) in fraction.items():
        own = [x["copies"] for x in rows if x["source"] == s]
        assert set(own) <= {int(t / z), int(t / z) + 1} or t == 2 * z
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(x["copies"] for x in rows)


@pytest.mark.parametrize("table", [awkward, empty])
def test_mixing_and_sharding_awkward(spark, table):
    docs = table(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in rows)
    records, put = sharding.shard(docs, shards=3)
    got = records.collect()
    assert len(got) == len(rows)
    check_shards(got, 3)
    assert sorted(r["vslot"] for r in put.collect()) == list(range(sharding.SLOTS))


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < shards
    for v in by.values():
        assert sorted(v) == list(range(len(v)))


def test_sharding(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op5_virtual_slots"](spark, sf_dir).collect()
    check_shards(rows, 40)
    texts = dict(zip(*(documents(sf_dir)[c] for c in ("doc_id", "text")), strict=True))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert len(load) == 40 and max(load.values()) < 1.02 * min(load.values())


def test_rebalancing_moves_only_into_the_new_shard(spark):
    weights = spark.range(2000).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % 97 + 5).alias("bytes"))
    old = sharding.new_map(weights, 10)
    new = sharding.rebalance(old, 11)
    a, b = ({r["vslot"]: r for r in m.collect()} for m in (old, new))
    assert all(b[s]["shard"] in (a[s]["shard"], 10) and b[s]["version"] == 2 for s in a)
    load = Counter()
    for r in b.values():
        load[r["shard"]] += r["bytes"]
    assert max(load.values()) < 1.05 * min(load.values())


def exact(ids, vectors, q, top=20):
    s = (vectors * vectors[ids == q][0]).sum(axis=1)
    some = np.flatnonzero(ids != q)
    return some[np.lexsort((ids[some], -s[some]))[:top]], s


def test_search_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pandas()
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_list()).astype(float)
    found = QUERIES["op10_collision_counting_search"](spark, sf_dir).toPandas()
    hit = n = 0
    assert set(found["query_id"]) == set(ids[ids % 20 == 0])
    for q, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21))
        want, s = exact(ids, x, q)
        score = dict(zip(ids, s, strict=True))
        assert np.allclose(g["score"], [score[i] for i in g["vec_id"]], rtol=0, atol=1e-12)
        assert [(-a, b) for a, b in zip(g["score"], g["vec_id"], strict=True)] == sorted((-a, b) for a, b in zip(g["score"], g["vec_id"], strict=True))
        hit, n = hit + len(set(ids[want]) & set(g["vec_id"])), n + 20
    assert hit / n >= 0.9


def test_search_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, []), (20, [-1.0, 3.0])]
    rows += [(100 + i, [2.0, 2.0]) for i in range(60)] + [(200, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("rank"), F.lit(2).alias("k1"))
    got = nearest.search(df).toPandas()
    assert sorted(got["query_id"].unique()) == [0, 20, 100, 120, 140, 200]
    for q in (0, 20, 100, 200):
        g = got[got["query_id"] == q].sort_values("rank")
        assert len(g) == 20 and g["vec_id"].tolist() == [i for i in range(100, 160) if i != q][:20]
    assert nearest.search(df.where("false")).count() == 0


@pytest.mark.parametrize("table", [awkward, empty])
def test_pipeline_stages_on_awkward_tables(spark, sf_dir, table):
    import corpus_pipeline

    docs = table(spark)
    rows = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns and {tuple(r) for r in after.collect()} <= rows, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.where("start = 0").count() == docs.count()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from pointweave.llm.base import materialize

    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, sf_dir), "test")
        assert after.columns == docs.columns and 0 < after.count()
        assert after.select("doc_id").distinct().join(before.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
        if name == "near duplicates":
            kept = {r["doc_id"] for r in after.select("doc_id").collect()}
            pdf = before.select("doc_id", "text").toPandas()
            assert [sum(int(i) in kept for i in g) for g in plain_classes(pdf["doc_id"].tolist(), pdf["text"].tolist())].count(1) == len(kept)
        before = after
    pieces = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert pieces["length"].max() <= 2048 and set(pieces["doc_id"]) == {r["doc_id"] for r in before.select("doc_id").collect()}


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_exact_similarities_and_tile_links(weighting):
    import pyarrow as pa

    r = np.random.default_rng(9)
    base = [f"w{i}" for i in r.integers(0, 12, 60)]
    texts = []
    for _ in range(24):
        own = list(base)
        for k in r.integers(0, 60, r.integers(0, 6)):
            own[k] = f"x{r.integers(0, 5)}"
        texts.append(" ".join(own))
    texts += ["", " ", "one two", "one two three four five", "one two"]

    def bag(t):
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])
        return c if weighting == "count" else Counter(set(c))

    def alike(a, b):
        x, y = bag(a), bag(b)
        return (x & y).total() / (x | y).total() if (x | y) else 1.0

    i, j = (np.array(v) for v in zip(*[(a, b) for a in range(len(texts)) for b in range(len(texts))], strict=True))
    found = near_duplicates.similarities(pa.array([texts[k] for k in i]), pa.array([texts[k] for k in j]), weighting=weighting)
    assert np.allclose(found, [alike(texts[a], texts[b]) for a, b in zip(i, j, strict=True)])
    one, two = texts[:12], texts[12:]
    links = near_duplicates.cross_links(pa.array(one), pa.array(two), list(range(12)), list(range(12, len(texts))), 5, 0.8, weighting)
    assert all(alike(one[a], two[b]) >= 0.8 for a, b in links)
    parent = list(range(len(texts)))

    def groups(pairs):
        root = list(range(len(texts)))

        def up(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            root[up(a)] = up(b)
        return sorted(map(sorted, {up(v): [w for w in parent if up(w) == up(v)] for v in parent}.values()))

    want = [(a, 12 + b) for a in range(12) for b in range(len(two)) if bag(one[a]) and bag(two[b]) and alike(one[a], two[b]) >= 0.8]
    assert groups((a, 12 + b) for a, b in links) == groups(want)
