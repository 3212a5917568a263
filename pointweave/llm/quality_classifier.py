"""A quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is compressed piece by piece with
either; the difference of the two sizes over their sum says which it resembles. A logistic curve over that figure
(and over how far the text compresses at all, as a text that repeats itself fits either dictionary) gives the score.
Pieces are short, so that the dictionary and not the text's own past decides; all pieces of a text count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import worker_memory
from .textscan import slices

PIECE = 1024
DICTIONARY = 32_768
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass
class Classifier:
    good: bytes
    bad: bytes
    weights: np.ndarray
    piece: int = PIECE

    def open(self) -> tuple:
        return tuple(_compressor(d) for d in (self.good, self.bad))

    def features(self, text: bytes, opened: tuple) -> tuple[float, float, float]:
        good, bad = opened
        pieces = [text[i : i + self.piece] for i in range(0, len(text), self.piece)]
        a, b = sum(len(good.compress(p)) for p in pieces), sum(len(bad.compress(p)) for p in pieces)
        return ((b - a) / (a + b) if a + b else 0.0, min(a, b) / len(text) if text else 1.0, float(np.log1p(len(text))))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_terms(features) @ self.weights, -30, 30)))


def _compressor(dictionary: bytes):
    plain = {"level": 1, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**plain)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=1)
    return zstandard.ZstdCompressor(dict_data=d, **plain)


def _terms(f: np.ndarray) -> np.ndarray:
    f = np.asarray(f, float).reshape(-1, 3)
    repeats = np.maximum(0.3 - f[:, 1], 0) * 10  # prose doesn't compress so far; the rest of the range says nothing
    short = 1 / (1 + f[:, 2])
    return np.stack([np.ones(len(f)), 10 * f[:, 0], repeats, short, 10 * f[:, 0] * short], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(1), -30, 30)))
        h = (x[:, :, None] * x[:, None, :] * (weight * p * (1 - p))[:, None, None]).sum(0) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, (x * (weight * (y - p))[:, None]).sum(0) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(samples: list[bytes], size: int) -> bytes:
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: their text is the dictionary
        return b"".join(samples)


def fitting(sizes: list[tuple[int, int, int]], most_bytes: int) -> list[int]:
    """The ids of (id, label, size) that are taken in turn as long as they fit into a label's most_bytes."""
    left: dict[int, int] = {}
    out = []
    for i, label, size in sizes:
        room = left.setdefault(label, most_bytes)
        if size <= room:
            left[label] = room - size
            out.append(i)
    for label in left.keys() - {label for i, label, _ in sizes if i in set(out)}:  # a label without any
        out.append(min((size, i) for i, own, size in sizes if own == label)[1])
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_bytes: int = 8 << 20, piece: int = PIECE, dictionary: int = DICTIONARY, held=held_out, seed: int = 5) -> Classifier:
    """Fit on at most per_class documents of each label, chosen by hash among those that aren't held out.

    Half of them give dictionary text: whole texts, in hash order, but for those with which a label's would have more than
    `most_bytes` in all (they are passed over; if none fits, the smallest is taken); lines that several of them share are left out, as boilerplate says nothing about a label. The other half, whole,
    gives the curve. Rows with null label or id take no part; of several texts of one id the least counts. If a class is
    missing its dictionary is empty.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where(~held(F.col("doc_id")))
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    chosen = known.where("quality = 1").orderBy(*order).limit(per_class).unionByName(known.where("quality = 0").orderBy(*order).limit(per_class))
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2)).cast("int"))
    picked = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "half").agg(F.min("text").alias("text"))
    # At most per_class rows a label.
    sizes = picked.where("half = 0").select("doc_id", "quality", F.octet_length("text").alias("size")).orderBy(*order).collect()
    fits = docs.sparkSession.createDataFrame([(i,) for i in fitting(sizes, most_bytes)], "doc_id long")
    rows = picked.join(F.broadcast(fits), "doc_id", "left_semi").select("doc_id", "quality", "text").orderBy("doc_id").collect()
    seen = Counter(line for r in rows for line in set(r["text"].split("\n")))
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows:
        own = "\n".join(x for x in r["text"].split("\n") if seen[x] == 1).encode()
        samples[r["quality"]] += [own[i : i + piece] for i in range(0, len(own), piece)]
    model = Classifier(_dictionary(samples[1], dictionary), _dictionary(samples[0], dictionary), np.zeros(5), piece)
    fit = _features(picked.where("half = 1").select("doc_id", "text"), model).join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id").orderBy("doc_id").toPandas()
    if len(fit):
        # Classes count as they do among all labels, so that a text that says nothing gets their share as its score.
        of = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
        y = fit["quality"].to_numpy(float)
        share = np.where(y == 1, of.get(1, 0) / max((y == 1).sum(), 1), of.get(0, 0) / max((y == 0).sum(), 1))
        model.weights = _logistic(_terms(np.array(fit["features"].tolist())), y, share / share.mean())
    return model


def _features(docs: DataFrame, model: Classifier) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        opened = model.open()
        for batch in batches:
            rows = [model.features(t.as_buffer().to_pybytes() if t.is_valid else b"", opened) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return docs.mapInArrow(run, "doc_id long, features array<double>")


def classify(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD, columns: bool = False) -> DataFrame:
    """For each row: doc_id, held_out, score, predicted; with columns=True, the rows predicted good as they are in docs.

    Null and empty texts get the curve's value for no text. Only the text is an input of the score; rows with equal
    or null ids are scored one by one; an empty table gives an empty result.
    """
    names = docs.columns
    text_at = names.index("text") if columns else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        opened = model.open()
        for batch in batches:
            for lo, hi in slices(batch.column(text_at)):
                part = batch.slice(lo, hi - lo)
                score = model.score(np.array([model.features(t.as_buffer().to_pybytes() if t.is_valid else b"", opened) for t in part.column(text_at)]))
                good = score >= threshold
                if columns:
                    yield part.filter(pa.array(good))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(good.astype(np.int32))], names=["doc_id", "score", "predicted"])

    if columns:
        return docs.mapInArrow(run, docs.schema)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
