"""Url filters, phrases and periodic runs against plain row-by-row versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointweave.llm import collocations, periodic_runs, queries, url_filter

from .helpers import awkward, empty

RULES = [
    ("com", "", "block"),
    ("example.com", "/", "allow"),
    ("Example.com", "/en/", "block"),
    ("www.example.com", "/e", "allow"),
    ("www.example.com", "/en", "block"),
    ("www.example.com", "/en/x", "allow"),
    ("net", "/es/", "block"),
    ("net", "/es/", "allow"),
    ("a.b.org", "/x/y.html", "block"),
    ("org:80", "/", "block"),
    ("ünï.de", "/é/", "block"),
]
URLS = [None, "", "no scheme/at all", "http://", "://com", "http://COM", "http://com/", "x://Example.COM/en/1", "x://example.com/en", "x://www.example.com/en/xyz?q=/es/", "x://www.example.com/e#/en/x", "x://www.example.com?/en/", "x://wwww.example.com/en/x", "x://a.net/es/1", "x://anet/es/1", "x://net/es", "x://a..net/es/", "x://.net/es/", "x://net./es/", "x://q.a.b.org/x/y.html", "x://b.org/x/y.html", "x://c.org:80/", "http://ünï.de/é/ü", "HTTP://ÜNÏ.de/é/", "x://y://com/", "x://h.com/" + "long/" * 50_000]


def judged(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    small = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    host = small(host)
    fit = [(len(small(h)), len(p), v == "block", small(h) + p, v) for h, p, v in rules if (host == small(h) or host.endswith("." + small(h))) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def test_urls_against_plain(spark):
    r = random.Random(2)
    label = lambda: r.choice(["a", "b", "com", "net", "A", ""])
    urls = URLS + ["s://" + ".".join(label() for _ in range(r.randint(1, 4))) + r.choice(["", "/"]) + "/".join(r.choice(["a", "ab", "b", ""]) for _ in range(r.randint(0, 4))) + r.choice(["", "?x/y", "#a"]) for _ in range(400)]
    rules = RULES + [(h, "/" + "/".join(r.choice(["a", "ab", "b", ""]) for _ in range(r.randint(0, 3))), r.choice(["allow", "block"])) for h in ("a", "b.com", "a.b", "com", "a.net") for _ in range(12)]
    pages = spark.createDataFrame([(i // 2 if i else None, u) for i, u in enumerate(urls)], "page_id long, url string").select("*", *[F.lit(1).alias(c) for c in ("host", "path", "rule", "verdict", "key", "row")])
    for default in ("allow", "block"):
        want = sorted(((i // 2 if i else None, *judged(u, rules, default)) for i, u in enumerate(urls)), key=str)
        for most in (url_filter.MOST_BYTES, 0):  # by the trie, by joins
            got = url_filter.judge(pages, rules, default, most)
            assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
            assert sorted(map(tuple, got.collect()), key=str) == want
            kept = url_filter.keep_allowed(pages, rules, default, most)
            assert kept.columns == pages.columns
            assert sorted(str(row.url) for row in kept.collect()) == sorted(str(u) for u in urls if judged(u, rules, default)[3] == "allow")
    assert {row.verdict for row in url_filter.judge(pages, []).collect()} == {"allow"}
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    for bad in (("", "/", "allow"), ("a/b", "/", "allow"), ("a", "b", "allow"), ("a", "/", "maybe")):
        with pytest.raises(ValueError, match="no rule"):
            url_filter.judge(pages, [bad])


def plain_phrases(rows, least, first):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {g: c for g, c in f.items() if c >= least}
    out = []
    for (lang, g), a in f.items():
        inside = lambda h, g=g: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        if len(g) < 2 or any(h[0] == lang and len(h[1]) > len(g) and inside(h[1]) and c >= a for h, c in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    out.sort()
    ranks = Counter()
    rows = []
    for lang, score, a, phrase, l, r in out:
        ranks[lang] += 1
        if ranks[lang] <= first:
            rows.append((lang, ranks[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return rows


def test_phrases_against_plain(spark):
    r = random.Random(4)
    word = lambda: r.choice(["The", "of", "x", "y", "Z", "é", "日本", "a\x00b", "rare%d" % r.randrange(300)])
    rows = [(r.choice(["en", "de", None]), "".join(word() + r.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"]) for _ in range(r.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), ("fr", "one two three one two three"), ("en", "of the of " * 3000)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").select("*", *[F.lit(1).alias(c) for c in ("key", "n", "f", "id", "word", "p")])
    for least, first in ((3, 40), (2, 2000)):
        want = plain_phrases(rows, least, first)
        for most in (collocations.MOST_BYTES, 0):  # numbers by broadcast, by join
            got = collocations.phrases(docs, least, first, most_bytes=most)
            assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
            assert sorted(map(tuple, got.collect())) == want


def test_windows_of_all_widths():
    r = np.random.default_rng(1)
    for width, top in ((2, 1 << 16), (3, 1 << 24), (4, 1 << 31)):
        ids = np.where(r.random(400) < 0.2, 0, np.where(r.random(400) < 0.5, r.integers(1, 4, 400), r.integers(1, top, 400)))
        fresh = r.random(400) < 0.1
        want = Counter()
        for i in range(400):
            w = [ids[i]]
            while len(w) < 5 and i + len(w) < 400 and not fresh[i + len(w)] and w[-1]:
                w.append(ids[i + len(w)])
            w = w[: w.index(0)] if 0 in w else w
            if len(w) > 1:
                want[b"".join(int(v).to_bytes(width, "big") for v in w + [0] * (5 - len(w)))] += 1
        keys, n = collocations.windows(ids, fresh, width)
        assert keys.to_pylist() == sorted(want)
        assert n.tolist() == [want[k] for k in sorted(want)]


def test_scores_beyond_64_bits(spark):
    """1000 a n and l r pass 64 bits here; the arithmetic stays exact."""
    a, n, l, r = 9_000_000_000_000_000, 90_000_000_000_000_000, 70_000_000_000_000_001, 80_000_000_000_000_003
    row = spark.sql(f"select {a}L a, {n}L n, {l}L l, {r}L r").selectExpr("(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) * 1000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) s").first()
    assert row.s == 1000 * a * n // (l * r)


def test_phrases_on_awkward_tables(spark):
    assert collocations.phrases(empty(spark)).count() == 0
    got = {(row.lang, row.phrase): row.a for row in collocations.phrases(awkward(spark), 2).collect()}
    assert got["en", "word word word word word"] == 29_996
    assert got["en", "the quick brown fox jumps"] == 3
    assert not any(lang == "fr" for lang, _ in got)


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def row_of(w):
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_runs_against_plain():
    r = random.Random(5)
    texts = [None, "", " \n", "a " * 400, "a b " * 300 + "c", "\x1c\u00a0 " * 7, "x y z " * 5 + "x x x x x x"]
    for _ in range(1500):
        w = [r.choice("abcdefghijklmnopqrst"[: r.choice([1, 2, 3, 5, 20])]) for _ in range(r.randint(0, 50))]
        if r.random() < 0.6 and w:
            a, p = r.randrange(len(w)), r.randint(1, 9)
            w = w[:a] + w[a : a + p] * r.randint(2, 9) + w[a:][: r.randint(0, 5)]
        texts.append(r.choice(["", "\t"]) + " ".join(w) + r.choice(["", " ", "\n "]))
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    names = [f.split()[0] for f in periodic_runs.OUT.split(", ")]
    for lo in range(0, len(texts), 300):
        got = periodic_runs.measure(pa.array(texts[lo : lo + 300], pa.string()), collapsed=True, spans=True)
        for i, t in enumerate(texts[lo : lo + 300]):
            assert [(x["start"], x["length"], x["period"]) for x in got["runs"][i]] == plain_runs(split(t))
            assert tuple(got[c][i] for c in names) == row_of(split(t)), t


def test_long_repeats_are_walked_in_linear_time():
    fib = ["b", "a"]
    while len(fib[-1]) < 4000:
        fib.append(fib[-1] + fib[-2])
    for w in (list(fib[-1]), ["a"] * 20_000, ["w%d" % (i % 977) for i in range(20_000)]):
        got = periodic_runs.measure(pa.array([" ".join(w), "x", " ".join(w)]), spans=True)
        if len(w) < 10_000:
            assert [(x["start"], x["length"], x["period"]) for x in got["runs"][0]] == plain_runs(w)
        else:
            assert [(x["start"], x["length"]) for x in got["runs"][0]] == [(0, len(w))]
        assert got["runs"][2] == got["runs"][0]


def test_the_query_plants_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {row.doc_id: tuple(row)[1:] for row in queries.op13_suffix_tree_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert got[d.doc_id] == row_of(w)


def test_runs_on_awkward_tables(spark):
    assert periodic_runs.find_runs(empty(spark)).count() == 0
    got = periodic_runs.find_runs(queries._with_planted_runs(awkward(spark)), collapsed=True).collect()
    assert len(got) == 11
    long = next(row for row in got if row.doc_id == 5)
    assert (long.n_runs, long.start, long.period, long.collapsed) in (((1, 0, 1, "word end")), ((1, 0, 1, "word")))
    assert [row.n_runs for row in got if row.doc_id in (2, 3, 4)] == [0, 0, 0]
