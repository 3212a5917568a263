"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are grown here (histograms of 64 bins, squared second order gain, logistic loss) with monotonic constraints
on chosen statistics, and flattened into numpy node arrays; scoring walks all documents of a batch through a tree at
once. Statistics come from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import worker_memory
from .textscan import Scan, mix64, repeated, slices

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Bytes of text that are measured at once (a longer text alone): that bounds a worker's memory.
SLICE = 1 << 18
#: Features of the trees, and the direction in which each may move the score (0: free).
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1, "digit_rate": -1, "punct_rate": 0, "distinct_rate": 0, "nonascii_rate": 0, "mean_line": 0, "long_words": 0}


def _lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int8)
    t[list(chars)] = 1
    return t


_SYMBOL, _UPPER, _DIGIT = _lut(SYMBOLS.encode()), _lut(bytes(range(65, 91))), _lut(bytes(range(48, 58)))
_PUNCT = _lut(b"!?.,;:'\"()[]{}-_/\\@^~`+=")


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The base statistics and FEATURES of each text (null: of the empty text)."""
    s = Scan(column)
    n_words = s.n_words
    lead = (s.data & 0xC0) != 0x80  # a byte that begins a code point
    chars = np.maximum(s.per_text(lead), 1)
    lead &= s.word
    out = {"n_words": n_words, "word_chars": s.per_text(lead), "n_symbols": s.per_text(_SYMBOL[s.data])}
    del lead
    out["n_dup_lines"], n_lines = _duplicate_lines(s)
    at, text, h = s.windows(REPEAT_WINDOW)
    hit = at[repeated(text, h)]
    del at, text, h
    edge = np.zeros(len(s.starts) + 1, np.int32)
    edge[hit] += 1  # a window begins at a word once
    edge[hit + REPEAT_WINDOW] -= 1
    covered = (np.cumsum(edge, out=edge)[:-1] > 0).astype(np.int8)
    per_words = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[s.first])
    out["n_repeat_words"] = per_words(covered)
    of = np.repeat(np.arange(s.n, dtype=np.int32), n_words)
    distinct = n_words - per_words(~_first_of(of, s.word_hashes()))
    words = np.maximum(n_words, 1)
    out |= {
        "log_words": np.log1p(n_words),
        "mean_word": out["word_chars"] / words,
        "symbol_rate": out["n_symbols"] / chars,
        "dup_line_rate": out["n_dup_lines"] / np.maximum(n_lines, 1),
        "repeat_rate": out["n_repeat_words"] / words,
        "upper_rate": s.per_text(_UPPER[s.data]) / chars,
        "digit_rate": s.per_text(_DIGIT[s.data]) / chars,
        "punct_rate": s.per_text(_PUNCT[s.data]) / chars,
        "distinct_rate": distinct / words,
        "nonascii_rate": s.per_text(s.data >= 0xC0) / chars,
        "mean_line": words / np.maximum(n_lines, 1),
        "long_words": per_words(s.ends - s.starts > 18) / words,
    }
    return out


def _first_of(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True at the first of equal (text, hash)."""
    with np.errstate(over="ignore"):
        key = mix64(h + mix64(text.astype(np.uint64) + np.uint64(0x7A3D19)))
    out = np.zeros(len(h), bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


def _duplicate_lines(s: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word that equal an earlier line, and lines with a word."""
    newline = s.data == 10
    breaks = np.flatnonzero(newline)
    lo = np.concatenate([s.at[:-1], breaks + 1])
    text = np.concatenate([np.arange(s.n), np.searchsorted(s.at, breaks, "right") - 1])
    order = np.argsort(lo, kind="stable")  # a text's own start comes before the lines of the same text
    lo, text = lo[order], text[order]
    order = np.argsort(text, kind="stable")
    lo, text = lo[order], text[order]
    hi = np.empty_like(lo)
    hi[:-1] = lo[1:] - 1
    last = np.flatnonzero(np.diff(text, append=s.n)) if len(text) else text
    hi[last] = s.at[text[last] + 1]
    has = np.searchsorted(s.starts, hi) > np.searchsorted(s.starts, lo)
    lo, hi, text = lo[has], hi[has], text[has]
    again = ~_first_of(text, s.hash_ranges(lo, hi))
    return np.bincount(text[again], minlength=s.n), np.bincount(text, minlength=s.n)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


class Trees:
    """Boosted trees as flat arrays: feature (-1: a leaf), threshold, left child (right is the next), value."""

    def __init__(self, feature, threshold, left, value, roots, start):
        self.feature, self.threshold, self.left, self.value, self.roots, self.start = feature, threshold, left, value, roots, start

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(inner, self.left[node] + right, node)
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 5.0, bins: int = 64, least: float = 5.0) -> Trees:
    """Grow boosted trees. Where only one class is present the score is constant.

    A split on a constrained feature is made only if its two leaf values stand in the allowed order; the bounds that
    this sets hold in all nodes below, so the whole score is monotone in that feature.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(x.shape[1])], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), start)
    feature, threshold, left, value, roots = [], [], [], [], []

    def new(v: float) -> int:
        feature.append(-1), threshold.append(0.0), left.append(-1), value.append(v)
        return len(feature) - 1

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + l2), lo, hi))

    for _ in range(trees if len(y) and y.min() != y.max() else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(new(0.0))
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, lo, hi = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * leaf(gs, hs, lo, hi)
            best = None
            if level < depth:
                gain_of = lambda v, g_, h_: -(g_ * v + 0.5 * (h_ + l2) * v * v)
                here = gain_of(leaf(gs, hs, lo, hi), gs, hs)
                for j in range(x.shape[1]):
                    if not len(cuts[j]):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(cuts[j]) + 1))[:-1]
                    vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(gs - gl) / (hs - hl + l2), lo, hi)
                    gain = gain_of(vl, gl, hl) + gain_of(vr, gs - gl, hs - hl) - here
                    gain[(hl < least) | (hs - hl < least) | (monotone[j] * (vr - vl) < 0)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k, vl[k], vr[k])
            if best:
                _, j, k, vl, vr = best
                middle = (vl + vr) / 2
                feature[node], threshold[node] = j, float(cuts[j][k])
                left[node] = new(0.0)
                new(0.0)
                goes = binned[rows, j] > k
                bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}[monotone[j]]
                todo.append((left[node], rows[~goes], level + 1, *bounds[0]))
                todo.append((left[node] + 1, rows[goes], level + 1, *bounds[1]))
            else:
                margin[rows] += value[node]
    return Trees(np.array(feature or [-1]), np.array(threshold or [0.0]), np.array(left or [-1]), np.array(value or [0.0]), roots, start)


_STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>"


def document_statistics(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, the base statistics, and the features as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE):
                st = statistics(batch.column(1).slice(lo, hi - lo))
                x = np.stack([st[f] for f in FEATURES], axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(st[c].astype(np.int64)) for c in BASE], flat], names=["doc_id", *BASE, "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _STATISTICS)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 11) -> Trees:
    """Trees for labels.quality from at most `sample` labelled documents that pass the base rules, chosen by hash.

    Only the sample's statistics (a few numbers a document) reach the driver. Rows with null label or id take no part;
    of several texts of one id the one with the least statistics counts, so reruns agree.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    one = document_statistics(picked).groupBy("doc_id").agg(F.min(F.struct(*BASE, "features")).alias("s")).select("doc_id", "s.*")
    rows = one.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toPandas()
    if len(rows):
        rows = rows[~base_failed(rows["n_words"].to_numpy(), rows["n_repeat_words"].to_numpy())]
    x = np.array(rows["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_trees(x, rows["quality"].to_numpy(dtype=float), list(FEATURES.values()))


def apply_rules(docs: DataFrame, model: Trees, keep_at: float = 0.5, columns: bool = False) -> DataFrame:
    """For each row: doc_id, base statistics, base_failed, kept, score; with columns=True, docs' kept rows as they are.

    Null and empty texts have no words and fail the base rules. Rows with equal or null ids are judged one by one.
    Whole texts count, whatever their length; an empty table gives an empty result; columns of any name stay as they are.
    """
    names = docs.columns
    text_at = names.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        for batch in batches:
            for lo, hi in slices(batch.column(text_at), SLICE):
                part = batch.slice(lo, hi - lo)
                st = statistics(part.column(text_at))
                failed = base_failed(st["n_words"], st["n_repeat_words"])
                score = model.score(np.stack([st[f] for f in FEATURES], axis=1))
                kept = ~failed & (score >= keep_at)
                if columns:
                    yield part.filter(pa.array(kept))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(names.index("doc_id")), *[pa.array(st[c].astype(np.int64)) for c in BASE], pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "score"])

    if columns:
        return docs.mapInArrow(judge, docs.schema)
    names = ["doc_id", "text"]
    text_at = 1
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double")
