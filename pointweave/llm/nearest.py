"""Approximate nearest neighbours by largest inner product, with collision-counting hashing.

Every vector is projected on a number of random lines; for each line a block of vectors keeps its projections as one
sorted array. Around a query's projection a window is opened on every line, and a vector's collisions are the windows
that hold it. Windows widen by a constant factor (virtual rehashing: wider buckets of the same sorted arrays) until
enough vectors reach the collision threshold; those are verified by the exact inner product in double precision.

Counting walks the sorted arrays from the windows' ends. A window that holds more than half of a block is counted from
outside: what lies beyond its ends on a line hasn't collided there. When windows widen only the entries between the old
ends and the new ones are walked.

Largest inner product becomes smallest distance by one more component, which lifts all vectors of a block to one norm.
All queries meet all rows, block against block: blocks have a fixed size, so a task's memory does too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch

BLOCK = 16_384
QUERY_BLOCK = 16_384


class LineIndex:
    """Sorted projections of a block of vectors, and for each line the vectors in that order."""

    def __init__(self, vectors: np.ndarray, lines: int, seed: int = 17):
        self.vectors = vectors
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.norm = float(norms.max())
        lift = np.sqrt(np.maximum(self.norm**2 - norms**2, 0))
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, lines))
        at = np.einsum("nd,dl->ln", np.column_stack([vectors, lift]), self.axes)
        order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, order, axis=1)
        self.order = order.astype(np.int32)
        self.spread = float(at.std()) or 1.0

    def ends(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """For each line and query the first entry in the window and the first beyond it."""
        low = np.stack([np.searchsorted(line, x - half) for line, x in zip(self.sorted, at, strict=True)])
        high = np.stack([np.searchsorted(line, x + half, "right") for line, x in zip(self.sorted, at, strict=True)])
        return low, high

    def candidates(self, queries: np.ndarray, least: int, threshold: float, half: float, factor: float) -> Iterator[np.ndarray]:
        """For each query the vectors with at least threshold * lines collisions, once there are `least` of them (all, if
        there are no more).
        """
        n, lines = len(self.vectors), len(self.sorted)
        least, need = min(least, n), math.ceil(threshold * lines)
        lengths = np.sqrt((queries * queries).sum(axis=1))
        order, level = list(self.order.astype(np.intp)), 0  # as they are counted
        for lo in range(0, len(queries), 256):
            q = queries[lo : lo + 256]
            at = np.einsum("qd,dl->lq", q * (self.norm / lengths[lo : lo + 256])[:, None], self.axes[:-1])
            levels: dict[int, list] = {}
            for i in range(len(q)):
                # Misses of each vector: lines on which it lies beyond the window. Hits only grow with the level, so the
                # search for the first level with enough of them may begin where the query before ended.
                misses, window, found = None, None, None
                while True:
                    if level not in levels:
                        levels[level] = [x.T.tolist() for x in self.ends(at, half * self.spread * factor**level)]
                    low, high = levels[level][0][i], levels[level][1][i]
                    if misses is None:
                        misses = self._walked([o[:a] for o, a in zip(order, low, strict=True)] + [o[b:] for o, b in zip(order, high, strict=True)])
                    elif found is None:
                        misses -= self._walked([o[a:b] for o, a, b in zip(order, low, window[0], strict=True)] + [o[a:b] for o, a, b in zip(order, window[1], high, strict=True)])
                    else:
                        misses += self._walked([o[a:b] for o, a, b in zip(order, window[0], low, strict=True)] + [o[a:b] for o, a, b in zip(order, high, window[1], strict=True)])
                    narrower = found is not None or window is None
                    window = (low, high)
                    hit = np.flatnonzero(misses <= lines - need)
                    if len(hit) >= least:
                        found = hit
                        if not narrower or not level:
                            break
                        level -= 1
                    else:
                        level += 1
                        if found is not None:
                            break
                yield found

    def _walked(self, entries: list[np.ndarray]) -> np.ndarray:
        """How often each vector stands in the entries."""
        return np.bincount(np.concatenate(entries), minlength=len(self.vectors))


def search_block(queries: np.ndarray, vectors: np.ndarray, top: int, share: float, threshold: float, half: float, factor: float, lines: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of the block that may be among its `top` nearest, ties included, and their scores."""
    index = LineIndex(vectors, lines)
    least = 10 * top + math.ceil(share * len(vectors))
    for q, rows in zip(queries, index.candidates(queries, least, threshold, half, factor), strict=True):
        score = (vectors[rows] * q).sum(axis=1)
        if len(rows) > top:
            keep = score >= np.partition(score, len(score) - top)[len(score) - top]
            rows, score = rows[keep], score[keep]
        yield rows, score


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, top: int = 20, every: int = 20, share: float = 0.03, threshold: float = 0.9, half: float = 1.8, factor: float = 1.03, lines: int = 224, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The nearest of each vector whose vec_id `every` divides: query_id, rank, vec_id, score.

    Equal vectors are searched once: of each distinct vector only its smallest top + 1 ids can be among anyone's
    nearest, so only those are kept as candidates, and equal queries share one search. Vectors that are null, zero, or
    hold null or non-finite components take no part, nor do rows without id; a repeated id is one candidate. Vectors of
    different lengths have no inner product, so each meets only those of its own length. An empty table gives an empty
    result; other columns are ignored.

    Of a block of n vectors at least 10 * top + share * n are verified for a query (all, if there are no more): the more,
    the higher the recall. A vector collides if its projection is within the window on a share `threshold` of the lines;
    `half` is the first half width, in standard deviations of the block's projections.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    rows = scratch.write(rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v")), "ann-rows")
    # The ids of one vector are few after a first cut within salted parts, however often it stands.
    salted = Window.partitionBy("k1", "k2", F.pmod(F.xxhash64("vec_id"), F.lit(256))).orderBy("vec_id")
    same = Window.partitionBy("k1", "k2").orderBy("vec_id")
    ids = rows.select("k1", "k2", "vec_id").distinct()
    for window in (salted, same):
        ids = ids.withColumn("__i", F.row_number().over(window)).where(F.col("__i") <= top + 1).drop("__i")
    ids = ids.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    one = rows.groupBy("k1", "k2").agg(F.first("v").alias("v"))
    base = scratch.write(one.join(ids, ["k1", "k2"]), "ann-distinct")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    wanted = base.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    n_base, n_query = base.count(), wanted.count()
    base_blocks, query_blocks = max(1, math.ceil(n_base / block)), max(1, math.ceil(n_query / query_block))
    everyone = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64(F.lit(2), "k1", "k2"), F.lit(n)).cast("int")
    left = base.select(part(base_blocks).alias("b"), everyone(query_blocks).alias("q"), F.size("v").alias("d"), F.lit(False).alias("is_query"), "k1", "k2", "v", "ids")
    right = wanted.select(everyone(base_blocks).alias("b"), part(query_blocks).alias("q"), F.size("v").alias("d"), F.lit(True).alias("is_query"), "k1", "k2", "v", F.lit(None).cast("array<bigint>").alias("ids"))

    def matrix(rows: pa.Table) -> np.ndarray:
        return rows.column("v").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1))

    def pair(group: pa.Table) -> pa.Table:
        asked = group.column("is_query")
        mine, theirs = group.filter(pc.invert(asked)), group.filter(asked)
        out: list[list] = [[], [], [], []]
        if mine.num_rows and theirs.num_rows:
            x, ids = matrix(mine), mine.column("ids").to_pylist()
            found = search_block(matrix(theirs), x, top + 1, share, threshold, half, factor, lines)
            for k1, k2, (hit, score) in zip(theirs.column("k1").to_pylist(), theirs.column("k2").to_pylist(), found, strict=True):
                best = sorted((-s, i) for r, s in zip(hit.tolist(), score.tolist(), strict=True) for i in ids[r])[: top + 1]
                for s, i in best:
                    out[0].append(k1), out[1].append(k2), out[2].append(i), out[3].append(-s)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(v, k) for n, v, k in zip(("k1", "k2", "vec_id", "score"), out, kinds, strict=True)})

    # Pairs of blocks take long for their bytes, by which adaptive execution would put them together; a named number stays.
    tasks = max(base_blocks * query_blocks, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = left.unionByName(right).repartition(tasks, "d", "b", "q")
    found = met.groupBy("d", "b", "q").applyInArrow(pair, "k1 long, k2 long, vec_id long, score double")
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    best = scratch.write(found.withColumn("__i", F.row_number().over(best)).where(F.col("__i") <= top + 1).drop("__i"), "ann-found")
    scratch.drop(base)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return asked.join(best, ["k1", "k2"]).where("vec_id != query_id").withColumn("rank", F.row_number().over(own).cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
