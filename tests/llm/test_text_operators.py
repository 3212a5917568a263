"""Token counts, token store, packing, rules, classifier and languages against brute force, round trips and edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pointweave.llm import language_id, packing, quality_classifier, quality_rules, token_counts, token_store
from pointweave.llm.encode import Encoder
from pointweave.llm.queries import QUERIES

from .helpers import AWKWARD, awkward, empty, labels, no_labels

public_tokenizers = pytest.importorskip("public_tokenizers")
ALPHABET = "ab \n\té#1' 　\x1c\x85\0ß́!İ"


def plain_library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def random_texts(n, longest=60, seed=1, more=()):
    r = random.Random(seed)
    return ["".join(r.choice([*ALPHABET, *more]) for _ in range(r.randrange(longest))) for _ in range(n)]


def texts_of(sf_dir):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_the_library(sf_dir, name, kind):
    path = str(public_tokenizers.path(name))
    texts = random_texts(2500) + random_texts(1500, 30, 2, ["<|endoftext|>", " <|startoftext|>", "<|ENDOFTEXT|>", "  "]) + list(texts_of(sf_dir).values())[:60] + ["", " ", "\n\n", "a\n\n\nb c", "a  b", "a \nb", "a\n b", "don't 's <|endoftext|>", "\n x"]
    encoder, library = Encoder(path, kind, memory=500), plain_library(path)
    for lo in range(0, len(texts), 100):
        some = texts[lo : lo + 100]
        ids, sizes = encoder.encode(some)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i, text in enumerate(some):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_counts_against_viterbi(spark, sf_dir):
    path = str(public_tokenizers.path(token_counts.VOCABULARY))
    scores, byte, longest = token_counts.vocabulary(path)

    def best(word):
        m, b = token_counts.MARK + word, [(0.0, 0)]
        for e in range(1, len(m) + 1):
            n = len(m[e - 1].encode())
            b.append(max([(b[e - 1][0] + n * byte, b[e - 1][1] - n)] + [(b[k][0] + scores[m[k:e]], b[k][1] - 1) for k in range(max(0, e - longest), e) if m[k:e] in scores]))
        return b[-1]

    texts = texts_of(sf_dir)
    found = {r["doc_id"]: r for r in QUERIES["op1_trie_token_counts"](spark, sf_dir).collect()}
    assert set(found) == set(texts)
    for i in list(texts)[:25]:
        want = [best(w) for w in texts[i].split()]
        assert (found[i]["n_pretokens"], found[i]["n_tokens"]) == (len(want), -sum(w[1] for w in want))
        assert found[i]["score"] == pytest.approx(sum(w[0] for w in want))


def test_token_store_round_trip(spark, sf_dir):
    library = plain_library(str(public_tokenizers.path(token_store.TOKENIZER)))
    rows = {r["doc_id"]: r for r in QUERIES["op7_plane_store"](spark, sf_dir).collect()}
    start = 0
    for i, text in sorted(texts_of(sf_dir).items()):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 1000])
def test_container(n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
    data = token_store.write_container(ids, block=64)
    assert (token_store.read_container(data) == ids).all()
    for lo, hi in ((0, n), (n // 3, 2 * n // 3), (n - 1, n), (7, 7)):
        if 0 <= lo <= hi:
            assert token_store.read_container(data, lo, hi).tolist() == ids[lo:hi].tolist()
    with pytest.raises(ValueError):
        token_store.read_container(b"x" * 40)


def check_packing(rows, texts):
    library = plain_library(str(public_tokenizers.path(packing.TOKENIZER)))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]]))
            assert "ids" not in r or packing.unpack(r["ids"], r["length"]).tolist() == ids[at : at + r["length"]].tolist()
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(by_seq) == list(range(len(by_seq)))
    return 1 - sum(r["length"] for r in rows) / 2048 / len(by_seq)


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    assert check_packing([r.asDict() for r in packing.pack(docs, with_ids=True).collect()], {r["doc_id"]: r["text"] for r in docs.collect()}) < 1
    assert check_packing(QUERIES["op3_cutting_stock_packing"](spark, sf_dir).collect(), texts_of(sf_dir)) < 0.05


def test_patterns_pack_every_piece():
    r = np.random.default_rng(0)
    for n, capacity in ((0, 16), (3, 16), (400, 64), (30_000, 32)):
        sizes = r.integers(1, capacity + 1, n)
        demand = Counter(sizes.tolist())
        plan = packing.solve_patterns(demand, capacity)
        packed = Counter()
        for pattern, k in plan:
            assert sum(c * m for c, m in pattern.items()) <= capacity and k > 0
            for c, m in pattern.items():
                packed[c] += m * k
        assert packed == demand
        if n > 1000:
            assert sum(k for _, k in plan) * capacity < 1.01 * sizes.sum()
    price, sizes = np.array([3.0, 5, 8]), np.array([2, 3, 5])
    assert packing.best_pattern(price, sizes, 10)[0] == max(3 * a + 5 * b + 8 * c for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= 10)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = Counter(x for x in (text or "").split("\n") if WORD.search(x))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(n - 1 for n in lines.values()), len(covered)


def test_statistics_against_plain_python(sf_dir):
    texts = [*list(texts_of(sf_dir).values())[:120], *random_texts(300, 300), None, "", "a b c d e f g h a b c d e f g h", "x\nx\n\nx\r\nx", *[r[1] for r in AWKWARD]]
    found = quality_rules.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(found[c][i]) for c in quality_rules.BASE) == plain_statistics(t)


def test_rules_query(spark, sf_dir):
    texts = texts_of(sf_dir)
    rows = {r["doc_id"]: r for r in QUERIES["op8_boosted_rules"](spark, sf_dir).collect()}
    for i, t in texts.items():
        want = plain_statistics(t)
        assert tuple(rows[i][c] for c in quality_rules.BASE) == want
        assert rows[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (rows[i]["base_failed"] and rows[i]["kept"])


def test_trees_are_monotone_and_learn():
    r = np.random.default_rng(0)
    x = r.uniform(size=(3000, 3))
    y = (r.uniform(size=3000) < np.where(x[:, 0] > 0.5, 0.1, 0.9) * (0.6 + 0.4 * np.sin(9 * x[:, 1]) ** 2)).astype(float)
    model = quality_rules.fit_trees(x, y, [-1, 0, 1])
    score = model.score(x)
    assert score[x[:, 0] < 0.5].mean() > 0.5 + score[x[:, 0] > 0.5].mean()
    for j, sign in ((0, -1), (2, 1)):
        a = x[:200].copy()
        lines = []
        for v in np.linspace(0, 1, 40):
            a[:, j] = v
            lines.append(model.score(a))
        assert (sign * np.diff(np.array(lines), axis=0) >= -1e-12).all()
    assert quality_rules.fit_trees(x[:0], y[:0], [0, 0, 0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_viterbi_against_plain():
    r = np.random.default_rng(0)
    for _ in range(150):
        states, counts, penalty = r.integers(1, 5), r.integers(0, 40, 5), 1.5
        s = np.round(r.normal(size=(counts.sum(), states)), 1).astype(np.float32)
        got, at = language_id.viterbi(s, counts, penalty, block=7), 0
        for c in counts:
            own, lab = s[at : at + c].astype(float), got[at : at + c]
            at += c
            if c:
                v = own[0].copy()
                for x in own[1:]:
                    v = np.maximum(v, v.max() - penalty) + x
                assert own[np.arange(c), lab].sum() - penalty * (np.diff(lab) != 0).sum() == pytest.approx(v.max())


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, sample=400)
    found = language_id.identify(docs, model, spans=True).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(found["doc_id"], found["held_out"], strict=True))
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert found["score"].between(0, 1).all()
    for text, spans in zip(found["text"][:50], found["spans"][:50], strict=True):
        assert sum(s["words"] for s in spans) == len(text.split())


def test_classifier_held_out(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, marks)
    found = quality_classifier.classify(docs, model).join(marks, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(found["doc_id"], found["held_out"], strict=True))
    held = found[found["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    assert ((found["score"] >= 0.7) == (found["predicted"] == 1)).all() and found["score"].between(0, 1).all()


@pytest.mark.parametrize("table", [awkward, empty])
@pytest.mark.parametrize("marks", [labels, no_labels])
def test_awkward_tables(spark, table, marks):
    docs = table(spark)
    n = docs.count()
    model = language_id.train(docs)
    found = language_id.identify(docs, model).collect()
    assert len(found) == n and all(r["lang_pred"] == "und" for r in found if r["doc_id"] in (2, 3, 4, 7))
    assert token_counts.count_tokens(docs).count() == n
    stored = token_store.round_trip(docs).collect()
    assert len(stored) == n and sorted(r["start"] for r in stored) == sorted(np.cumsum([0, *[r["n_tokens"] for r in sorted(stored, key=lambda r: r["start"])]])[:n].tolist())
    pieces = packing.pack(docs, with_ids=True).collect()
    assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    assert sum(r["start"] == 0 for r in pieces) == n
    rules = quality_rules.train(docs, marks(spark))
    assert quality_rules.apply_rules(docs, rules).count() == n
    assert quality_rules.apply_rules(docs, rules, columns=True).columns == docs.columns
    scorer = quality_classifier.train(docs, marks(spark))
    assert quality_classifier.classify(docs, scorer).count() == n
    assert quality_classifier.classify(docs, scorer, columns=True).count() <= n
