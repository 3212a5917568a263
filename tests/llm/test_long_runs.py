"""Languages of text without spaces: every letter counts, wherever it stands in a run."""

import random

import pytest
from pyspark.sql import functions as F

from pointweave.llm import language_id

WORDS = {"aa": ["kalo", "mirak", "tolak", "karim", "lotak"], "bb": ["sheng", "wengsh", "engwu", "ushen", "gewush"], "cc": ["日本", "本日山", "山川日"]}


def some(lang, n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS[lang]) for _ in range(n)]


def test_long_runs(spark):
    docs = spark.createDataFrame([(i, " ".join(some(lang, 60, i)), lang) for i in range(60) for lang in WORDS], "doc_id long, text string, lang string")
    model = language_id.train(docs, held=lambda c: F.lit(False))
    join = lambda sep, *parts: sep.join(w for lang, n in parts for w in some(lang, n, n))
    texts = {
        1: join("", ("aa", 25), ("bb", 400)),
        2: join("-", ("aa", 25), ("bb", 400)),
        3: join("", ("aa", 5), ("cc", 400)),
        4: join("", ("cc", 30), ("aa", 300), ("bb", 60)),
        5: join("", ("bb", 40)),
    }
    found = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model, spans=True).collect()}
    assert {i: r["lang_pred"] for i, r in found.items()} == {1: "bb", 2: "bb", 3: "cc", 4: "aa", 5: "bb"}
    assert [s["lang"] for s in found[1]["spans"]] == [s["lang"] for s in found[2]["spans"]] == ["aa", "bb"]
    assert [s["lang"] for s in found[4]["spans"]] == ["cc", "aa", "bb"]
    for i, r in found.items():
        assert sum(s["letters"] for s in r["spans"]) == sum(c.isalpha() for c in texts[i])
        assert sum(s["words"] for s in r["spans"]) == len(texts[i].split())
        truth = sum(map(len, some("bb", 400, 400))) / sum(c.isalpha() for c in texts[i])
        assert i not in (1, 2) or abs(r["score"] - truth) < 0.02


def test_steps_hold_every_letter_and_gram():
    r = random.Random(1)
    for n in (1, 31, 32, 33, 64, 65, 1000):
        word = "".join(r.choice("abcdefé") for _ in range(n))
        steps = list(language_id.steps_of(word))
        assert sum(s[1] for s in steps) == n and all(s[1] <= 32 for s in steps)
        assert sorted(g for s in steps for g in s[2] if g[0] != "=") == sorted(g for g in language_id.grams_of(word) if g[0] != "=")
    assert [s[:2] for s in language_id.steps_of("Hello,日本語です123мир́а")] == [("latin", 5), ("han", 3), ("kana", 2), ("cyrillic", 4)]


def test_long_texts_take_little_memory():
    """20 MB without a space, in a process of its own: what it takes beyond the text."""
    import subprocess
    import sys
    from pathlib import Path

    run = """
import random, resource, sys
import numpy as np
import public_tokenizers
from pointweave.llm import encode, token_counts
r = random.Random(1)
kind = sys.argv[1]
clause = lambda: "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(r.randint(4, 30))) + "\u3002"
some = "".join(clause() for _ in range(20_000))
text = some * (20_000_000 // len(some.encode()) + 1)
job = {
    "trie": lambda: token_counts.TrieCounter(str(public_tokenizers.path(token_counts.VOCABULARY))).texts,
    "space": lambda: encode.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")), "space").encode,
    "word": lambda: encode.Encoder(str(public_tokenizers.path("word_bpe_49k.json")), "word").encode,
}[kind]()
job(["a few words first"])
if kind == "trie":
    text = text[: len(text) // 20]  # a word of 1 MB
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
job([text])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    for kind, most in (("trie", 60), ("space", 700), ("word", 700)):
        out = subprocess.run([sys.executable, "-c", run, kind], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], check=True)
        assert int(out.stdout) < most, (kind, out.stdout)


def test_long_pieces_are_cut_where_the_library_splits():
    import random

    import public_tokenizers

    from pointweave.llm import encode

    r = random.Random(2)
    parts = ["日本語", "中文字", "。", "，", "abc", "It's", "x'", "'s", "12", "٣", "½", "é", ".", "...", "!?", "한글", "Ω", "_", "-", "<", "\u0301", "ﬁ", "Ⅷ"]
    for name, kind in (("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "word")):
        e = encode.Encoder(str(public_tokenizers.path(name)), kind)
        for n in (3000, 6000):
            text = "".join(r.choice(parts) for _ in range(n))
            for t in (text, "a b " + text + " c\n" + text):
                ids, _ = e.encode([t])
                assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_long_words_score_as_short_ones_do():
    import public_tokenizers

    from pointweave.llm import token_counts

    c = token_counts.TrieCounter(str(public_tokenizers.path(token_counts.VOCABULARY)))
    words = ["international" * 3, "日本語" * 12, "x" * 60, "ab1_" * 9]
    n, tokens, score = c.texts(words)
    for w, t, s in zip(words, tokens, score, strict=True):
        assert c._walk(token_counts.MARK + w) == pytest.approx((s, t))


def test_a_document_that_does_not_fit_is_passed_over():
    from pointweave.llm.quality_classifier import fitting

    assert fitting([(1, 1, 9), (2, 1, 3), (3, 0, 5), (4, 1, 4), (5, 1, 2)], 8) == [2, 3, 4]
    assert fitting([(1, 1, 9), (2, 1, 12), (3, 0, 5)], 8) == [3, 1]
    assert fitting([], 8) == []
