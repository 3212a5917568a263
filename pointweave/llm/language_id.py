"""Language identification of mixed-language text.

Words are cut into steps: runs of letters of one script, long runs into pieces. A step's script (by code point ranges)
narrows its candidate languages; character n-grams score the candidates; and Viterbi over a text's steps with a
penalty for every switch labels spans of one language. The text's language is
the one that labels most of its letters.

Viterbi is exact for texts of any length: texts are cut into blocks, all blocks of a batch advance together for every
possible state before them, and the blocks of a text are then chained, forward for scores and backward for labels.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import worker_memory
from .textscan import slices

#: Code point ranges of scripts.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0xAC00, 0xD7AF), (0x1100, 0x11FF)),
}
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = sorted((lo, hi, name) for name, ranges in SCRIPTS.items() for lo, hi in ranges)
_LOW = [lo for lo, _, _ in _EDGES]
NO_WAY = -1e4
#: The step of a word without letters.
NO_STEP = [("other", 0, [""])]
#: Grams that are looked up at once.
GRAMS = 1 << 18
#: Longer runs of letters are cut into pieces of at most so many.
PIECE = 32


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@lru_cache(1 << 16)
def script_of(char: str) -> str:
    if "a" <= char <= "z":
        return "latin"
    i = bisect_right(_LOW, ord(char)) - 1
    return _EDGES[i][2] if i >= 0 and ord(char) <= _EDGES[i][1] else "other"


def runs_of(word: str) -> list[tuple[str, str]]:
    """(script, letters) of the runs of letters of a word in lower case.

    A run ends where the script changes. Letters of no listed script and combining marks don't end it.
    """
    if word.isascii():
        return [("latin", r) for r in _LETTERS.findall(word.lower())]
    out: list[tuple[str, str]] = []
    run, script = [], "other"
    for c in [*word.lower(), " "]:
        if c.isalpha():
            own = script_of(c)
            if own != "other" and script not in (own, "other"):
                out.append((script, "".join(run)))
                run = []
            script = script if own == "other" else own
            run.append(c)
        elif run and unicodedata.category(c)[0] == "M":
            run.append(c)
        elif run:
            out.append((script, "".join(run)))
            run, script = [], "other"
    return out


def grams_of(letters: str) -> list[str]:
    """The n-grams of a run of letters: pairs and triples with its edges, and the run itself."""
    w = f"^{letters}$"
    return [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)] + [f"={letters}"]


def steps_of(word: str) -> Iterator[tuple[str, int, list[str]]]:
    """(script, number of letters, n-grams) of each step of a word.

    A long run's pairs and triples belong to the piece in which they begin, so none is lost between two pieces.
    """
    for script, letters in runs_of(word):
        count = len if letters.isalpha() else lambda x: sum(c.isalpha() for c in x)
        n = len(letters)
        if n <= PIECE:
            yield script, count(letters), grams_of(letters)
            continue
        w, pieces = f"^{letters}$", -(-n // PIECE)
        for k in range(pieces):
            lo, hi = k * n // pieces, (k + 1) * n // pieces
            end = n + 1 if hi == n else hi
            yield script, count(letters[lo:hi]), [w[i : i + 2] for i in range(lo, end)] + [w[i : i + 3] for i in range(lo, min(end, n))]


@dataclass
class Model:
    languages: list[str]
    grams: dict[str, int]
    scores: np.ndarray  # a row for each gram, the last for unknown ones; a column for each language
    allowed: dict[str, np.ndarray]  # script -> which languages use it
    penalty: float = 12.0
    memory: int = 400_000
    _known: dict[str, int] = field(default_factory=dict)
    _rows: list[np.ndarray] = field(default_factory=list)
    _weights: list[np.ndarray] = field(default_factory=list)
    _firsts: list[np.ndarray] = field(default_factory=list)  # each word's first step
    _sizes: list[np.ndarray] = field(default_factory=list)  # each word's number of steps
    _n: int = 0  # steps

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self._known, self._rows, self._weights, self._firsts, self._sizes, self._n = {}, [], [], [], [], 0

    def _learn(self, words: list[str]) -> None:
        """Scores and letters of the steps of new words; a word without letters is one step."""
        index, starts, weights, masks, sizes, parts = [], [], [], [], [], []
        everyone = np.ones(len(self.languages), bool)
        unknown, get = len(self.scores) - 1, self.grams.get
        for w in words:
            before = len(weights)
            for script, n, grams in chain(steps_of(w), NO_STEP):
                if grams == [""] and len(weights) > before:  # there was a step
                    break
                if len(index) > GRAMS:
                    parts.append(np.add.reduceat(self.scores[index], starts, axis=0))
                    index, starts = [], []
                starts.append(len(index))
                weights.append(n)
                masks.append(self.allowed.get(script, everyone) if n else everyone)
                index += [get(g, unknown) for g in grams]
            sizes.append(len(weights) - before)
        if starts:
            parts.append(np.add.reduceat(self.scores[index], starts, axis=0))
        rows = np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)
        weights, sizes = np.array(weights, np.int32), np.array(sizes, np.int64)
        rows[weights == 0] = 0
        rows[~np.array(masks, bool).reshape(rows.shape)] += NO_WAY
        self._known.update(zip(words, range(len(self._known), len(self._known) + len(words)), strict=True))
        self._rows.append(rows.astype(np.float32))
        self._weights.append(weights)
        self._firsts.append(self._n + np.cumsum(sizes) - sizes)
        self._sizes.append(sizes)
        self._n += len(weights)

    def steps(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Step scores, step letters, each text's number of steps, and each word's number of steps."""
        if self._n > self.memory:
            self._forget()
        every, counts = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = t.split()
            counts[i] = len(own)
            every += own
        get = self._known.get
        where = np.fromiter((get(w, -1) for w in every), np.int64, len(every))
        if (new := np.flatnonzero(where < 0)).size:
            self._learn(list(dict.fromkeys([every[i] for i in new])))
            where[new] = np.fromiter((get(every[i]) for i in new), np.int64, len(new))
        if len(self._rows) > 1:
            self._rows, self._weights, self._firsts, self._sizes = ([np.concatenate(x)] for x in (self._rows, self._weights, self._firsts, self._sizes))
        if not self._rows:
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int32), counts, np.zeros(0, np.int64)
        sizes = self._sizes[0][where]
        ends = np.cumsum(sizes)
        step = np.repeat(self._firsts[0][where] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        last = np.concatenate([[0], ends])[np.cumsum(counts)]
        return self._rows[0][step], self._weights[0][step], np.diff(last, prepend=0), sizes

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The language (index) of every step of the texts, the steps' letters, each text's number of steps, and each word's."""
        scores, weights, counts, sizes = self.steps(texts)
        return viterbi(scores, counts, self.penalty), weights, counts, sizes


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float, block: int = 256) -> np.ndarray:
    """The best labels of each sequence (counts: the sequences' lengths) if every change of label costs the penalty.

    Ties go to no change, then to the smaller label.
    """
    n, states = scores.shape
    if not n:
        return np.zeros(0, np.int8)
    first = np.cumsum(counts) - counts
    blocks = -(-counts // block)
    owner = np.repeat(np.arange(len(counts)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[owner] + number * block
    size = np.minimum(block, first[owner] + counts[owner] - begin)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(block), "left")  # blocks longer than t
    begin_o = begin[order]
    transfer = np.full((len(owner), states, states), -np.inf, np.float64)  # before the block, after it
    transfer[:, np.arange(states), np.arange(states)] = 0
    for t in range(int(size.max())):
        k = live[t]
        v = transfer[:k]
        np.maximum(v, v.max(axis=2, keepdims=True) - penalty, out=v)
        v += scores[begin_o[:k] + t][:, None, :]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    entry = np.zeros((len(owner), states))
    start_of = np.cumsum(blocks) - blocks
    for j in range(int(blocks.max()) - 1):
        here = start_of[blocks > j + 1] + j
        entry[here + 1] = (entry[here][:, :, None] + transfer[back[here]]).max(axis=1)
    del transfer
    stay = np.zeros((block, len(owner), states), bool)
    best = np.zeros((block, len(owner)), np.int8)
    v = entry[order]
    for t in range(int(size.max())):
        k = live[t]
        now = v[:k]
        best[t, :k] = now.argmax(axis=1)
        switched = now.max(axis=1, keepdims=True) - penalty
        stay[t, :k] = now >= switched
        v[:k] = np.maximum(now, switched) + scores[begin_o[:k] + t]
    # Backward for every state after a block: the labels, and the state before the block.
    path = np.zeros((block, len(owner), states), np.int8)
    state = np.tile(np.arange(states, dtype=np.int8), (len(owner), 1))
    for t in range(int(size.max()) - 1, -1, -1):
        k = live[t]
        path[t, :k] = state[:k]
        state[:k] = np.where(np.take_along_axis(stay[t, :k], state[:k].astype(np.intp), axis=1), state[:k], best[t, :k, None])
    after = np.zeros(len(owner), np.int64)
    last = (start_of + blocks - 1)[blocks > 0]
    after[last] = v[back[last]].argmax(axis=1)
    for j in range(int(blocks.max()) - 1, 0, -1):
        here = start_of[blocks > j] + j
        after[here - 1] = state[back[here], after[here]]
    t = np.arange(n) - np.repeat(begin, size)
    return path[t, np.repeat(back, size), np.repeat(after, size)]


def train(docs: DataFrame, sample: int = 4000, most_grams: int = 60_000, held=held_out, seed: int = 3, penalty: float = 12.0) -> Model:
    """Fit from text and lang of at most `sample` documents, chosen by hash among those that aren't held out.

    Gram counts are summed by Spark; the driver gets at most most_grams grams of each language.
    """
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(~held(F.col("doc_id")))
    ids = usable.select("doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    picked = usable.select("doc_id", "lang", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                grams: Counter = Counter()
                words: Counter = Counter((lang, w) for lang, text in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True) for w in text.split())
                for (lang, w), n in words.items():
                    for script, _, own in steps_of(w):
                        for g in own:
                            grams[lang, g] += n
                        grams[lang, f"#{script}"] += n
                keys = list(grams)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([grams[k] for k in keys], pa.int64())], names=["lang", "gram", "n"])

    counts = picked.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    # A language's grams are bounded by the sample; the cut is made within hashed parts first, then for each language.
    top = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64)))
    for keys in (["lang", "part"], ["lang"]):
        top = top.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "gram"))).where(F.col("__i") <= most_grams).drop("__i")
    rows = top.drop("part").collect()
    languages = sorted({r["lang"] for r in rows})
    at = {x: i for i, x in enumerate(languages)}
    grams = {g: i for i, g in enumerate(sorted({r["gram"] for r in rows if r["gram"][0] != "#"}))}
    table = np.zeros((len(grams) + 1, max(len(languages), 1)))
    scripts: dict[str, np.ndarray] = {}
    for r in rows:
        if r["gram"][0] == "#":
            scripts.setdefault(r["gram"][1:], np.zeros(len(languages)))[at[r["lang"]]] = r["n"]
        else:
            table[grams[r["gram"]], at[r["lang"]]] = r["n"]
    log = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table)))
    log -= log.mean(axis=1, keepdims=True)  # only differences between languages count
    log[-1] = 0
    used = {s: n / np.maximum(sum(scripts.values()), 1) > 0.01 for s, n in scripts.items()}
    return Model(languages, grams, log.astype(np.float32), {s: a for s, a in used.items() if a.any()}, penalty)


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """For each row: doc_id, held_out, lang_pred, score (the share of letters in that language); with spans=True also
    spans, an array of (lang, first, words, letters): the word in which it begins, the words that begin in it, its letters.

    Null texts and texts without a letter are `und` with score 0. Where nothing was learnt all are `und`. Only the
    text is an input. Rows with equal or null ids are judged one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        names = np.array([*model.languages, UNKNOWN], object)
        width = len(model.languages)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo).fill_null("").to_pylist()
                if width:
                    labels, weights, counts, sizes = model.label(texts)
                    of = np.repeat(np.arange(len(texts)), counts)
                    share = np.bincount(of * width + labels, weights, len(texts) * width).reshape(-1, width)
                else:
                    labels, weights, counts, sizes, share = np.zeros(0, np.int8), np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(0, np.int64), np.zeros((len(texts), 1))
                total = share.sum(axis=1)
                best = np.where(total > 0, share.argmax(axis=1), width)
                out = [batch.column(0).slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(share.max(axis=1) / np.maximum(total, 1))]
                fields = ["doc_id", "lang_pred", "score"]
                if spans:
                    begins = np.zeros(len(labels), np.int64)  # 1 where a step is its word's first
                    begins[np.cumsum(sizes) - sizes] = 1
                    ends = np.cumsum(counts)
                    rows = []
                    for e, c in zip(ends, counts, strict=True):
                        own, words, n = labels[e - c : e], np.concatenate([[0], np.cumsum(begins[e - c : e])]), weights[e - c : e]
                        cuts = np.flatnonzero(np.diff(own, prepend=-1)) if c else own
                        rows.append([{"lang": model.languages[own[a]], "first": int(words[a + 1] - 1), "words": int(words[b] - words[a]), "letters": int(n[a:b].sum())} for a, b in zip(cuts, [*cuts[1:], c], strict=True)] if c else [])
                    out.append(pa.array(rows, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32()), ("letters", pa.int32())]))))
                    fields.append("spans")
                yield pa.RecordBatch.from_arrays(out, names=fields)

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,first:int,words:int,letters:int>>" * spans
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return found.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", *["spans"] * spans)
