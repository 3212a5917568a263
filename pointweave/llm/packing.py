"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents are tokenized whole and cut into full sequences and a rest. Rests are counted by length class (the unit is
a few tokens, so there is a fixed number of classes). A linear program over packing patterns is solved by column
generation: the simplex method prices classes, a knapsack dynamic program finds the pattern worth most, until none is
worth more than a sequence. The patterns' rounded-down numbers are used as they are; what remains is packed longest
first. Only the class counts reach the driver. Pieces are numbered within their class without a global sort (each task
numbers its own, each class adds its tasks' counts up), and the number says which sequence a piece goes to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize
from .encode import encoder as worker_encoder
from .textscan import slices

LENGTH = 2048
UNIT = 16
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"


def id_type(vocabulary: int) -> str:
    """How packed ids are written: little-endian, in 16 bits where the vocabulary fits, else in 32."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def unpack(ids: bytes, length: int) -> np.ndarray:
    """The ids of a piece of that length."""
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4")


def cut_documents(docs: DataFrame, path: str, kind: str = "space", length: int = LENGTH, unit: int = UNIT, end_id: int = END_ID, with_ids: bool = False, memory: int = 200_000) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, cls, part, rank_in_part (and ids: packed)."""
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, part int, rank_in_part long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, kind, memory)
        kind_of_id = id_type(max(encoder.vocabulary, end_id + 1))
        part = TaskContext.get().partitionId()
        seen = np.zeros(length // unit + 1, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(1), 1 << 19):
                doc_ids = batch.column(0).slice(lo, hi - lo)
                ids, sizes = encoder.encode(batch.column(1).slice(lo, hi - lo).fill_null("").to_pylist())
                ends = np.cumsum(sizes)
                row, start, size, crc, total, kept = [], [], [], [], [], []
                for i in range(len(sizes)):
                    own = np.append(ids[ends[i] - sizes[i] : ends[i]], np.int32(end_id)).astype("<u4")
                    for at in range(0, len(own), length):
                        piece = own[at : at + length]
                        row.append(i), start.append(at), size.append(len(piece)), crc.append(zlib.crc32(piece)), total.append(len(own))
                        if with_ids:
                            kept.append(piece.astype(kind_of_id).tobytes())
                cls = -(-np.array(size) // unit)
                order = np.argsort(cls, kind="stable")
                counts = np.bincount(cls, minlength=len(seen))
                rank = np.empty(len(cls), np.int64)
                rank[order] = np.arange(len(cls)) - np.repeat(np.cumsum(counts) - counts, counts)
                rank += seen[cls]
                seen += counts
                columns = [doc_ids.take(pa.array(row, pa.int32())), *[pa.array(x, pa.int64()) for x in (start, size, crc, total)], pa.array(cls, pa.int32()), pa.array(np.full(len(cls), part), pa.int32()), pa.array(rank)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "part", "rank_in_part"]
                if with_ids:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)


def best_pattern(price: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes (ascending) within the capacity of the highest total price (unbounded knapsack), as counts."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if k := fitting[w]:
            value = best[w - sizes[:k]] + price[:k]
            i = value.argmax()
            if value[i] > best[w] + 1e-12:
                best[w], choice[w] = value[i], i
    counts = np.zeros(len(sizes), np.int64)
    w = capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            counts[choice[w]] += 1
            w -= sizes[choice[w]]
    return float(best[capacity]), counts


def _inverse(a: np.ndarray) -> np.ndarray:
    """By elimination, without a linear algebra library: its threads would fight Spark's for so small a matrix."""
    n = len(a)
    both = np.hstack([a.astype(float), np.eye(n)])
    for i in range(n):
        j = i + int(np.argmax(np.abs(both[i:, i])))
        both[[i, j]] = both[[j, i]]
        both[i] /= both[i, i]
        rest = both[:, i].copy()
        rest[i] = 0
        both -= rest[:, None] * both[i]
    return both[:, n:]


def solve_patterns(demand: dict[int, int], capacity: int, rounds: int = 3000, close: float = 5e-4) -> list[tuple[dict[int, int], int]]:
    """Class counts -> (pattern: class -> pieces, number of sequences), which pack every piece.

    Every basis of the linear program is a valid packing, so to stop within `close` of the lower bound, or after
    `rounds` pivots, costs padding only.
    """
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(c)] for c in sizes], dtype=float)
    basis = np.diag(capacity // sizes).astype(float)  # a column is a pattern
    inverse = np.diag(1.0 / (capacity // sizes))
    amount = (inverse * need).sum(axis=1)
    # Prices are drawn towards the best known ones (at first the sizes themselves): raw prices swing from pivot to pivot.
    center = sizes / capacity
    bound = (center * need).sum()
    for turn in range(rounds):
        price = inverse.sum(axis=0)
        for pull in (0.9, 0.6, 0.0):
            drawn = pull * center + (1 - pull) * price
            worth, column = best_pattern(drawn, sizes, capacity)
            if (drawn * need).sum() / worth > bound:
                bound, center = (drawn * need).sum() / worth, drawn / worth
            if (price * column).sum() > 1 + 1e-7:
                break
        if (price * column).sum() <= 1 + 1e-7 or amount.sum() <= bound * (1 + close):
            break
        step = (inverse * column).sum(axis=1)
        up = step > 1e-9
        ratio = np.full(len(sizes), np.inf)
        ratio[up] = np.maximum(amount[up], 0) / step[up]
        leave = int(np.argmin(ratio))
        amount -= ratio[leave] * step
        amount[leave] = ratio[leave]
        basis[:, leave] = column
        pivot = inverse[leave] / step[leave]
        inverse -= np.outer(step, pivot)
        inverse[leave] = pivot
        if turn % 200 == 199:
            inverse = _inverse(basis)
            amount = (inverse * need).sum(axis=1)
    plan = []
    left = need.astype(np.int64)
    for j in np.argsort(-amount):
        column = basis[:, j].astype(np.int64)
        most = min(left[column > 0] // column[column > 0], default=0)
        if (n := min(int(amount[j] + 1e-9), int(most))) > 0:
            plan.append((column, n))
            left -= n * column
    large = sizes + (sizes / capacity) ** 2 / 2  # fill the most; of equal fillings, that with long pieces
    while left.any():
        here = np.flatnonzero(left)
        column = np.zeros(len(sizes), np.int64)
        column[here[-1]] = 1
        room = capacity - int(sizes[here[-1]])
        _, more = best_pattern(large[here], sizes[here], room)
        more = np.minimum(more, (left - column)[here])
        column[here] += more
        room -= int((more * sizes[here]).sum())
        for i in here[::-1]:
            if (k := min(int(left[i] - column[i]), room // int(sizes[i]))) > 0:
                column[i] += k
                room -= k * int(sizes[i])
        n = int(min(left[column > 0] // column[column > 0]))
        plan.append((column, n))
        left -= n * column
    return [({int(c): int(k) for c, k in zip(sizes, column, strict=True) if k}, n) for column, n in plan]


def slots_of(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each class and pattern: from which rank on a piece goes to which sequences and slots."""
    rows, used, sequence = [], {}, 0
    for pattern, n in plan:
        slot = 0
        for c in sorted(pattern, reverse=True):
            rows.append((c, used.get(c, 0), pattern[c], sequence, slot))
            used[c] = used.get(c, 0) + pattern[c] * n
            slot += pattern[c]
        sequence += n
    t = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (t[:, 0] << 48) | t[:, 1], "rank": t[:, 1], "each": t[:, 2], "sequence": t[:, 3], "slot": t[:, 4]}


def pack(docs: DataFrame, tokenizer: str | None = None, kind: str = "space", length: int = LENGTH, unit: int = UNIT, end_id: int = END_ID, with_ids: bool = False, memory: int = 200_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if wanted, packed
    as id_type() says (see unpack()).

    Null text is empty; every document has at least its end id, so each row of docs, repeated ones too, has a piece.
    Texts of any length are cut at multiples of the sequence length. Null and repeated ids are kept as they are; other
    columns are ignored; an empty table gives an empty result. Sequences are numbered from 0 without a gap. memory: encoded
    pieces that a worker keeps.
    """
    path = tokenizer or str(public_tokenizers.path(TOKENIZER))
    pieces = materialize(cut_documents(docs, path, kind, length, unit, end_id, with_ids, memory), "pack-pieces")
    per_part = pieces.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("n"))
    demand = {r["cls"]: r["n"] for r in per_part.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # at most length / unit rows
    table = slots_of(solve_patterns(demand, length // unit))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select(F.col("cls").alias("__c"), F.col("part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    ranked = pieces.join(starts, (F.col("cls") == F.col("__c")) & (F.col("part") == F.col("__p"))).withColumn("rank", F.col("__start") + F.col("rank_in_part")).drop("__c", "__p", "__start", "part", "rank_in_part")
    kept = [c for c in ranked.columns if c not in ("cls", "rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = batch.column("cls").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            i = np.searchsorted(table["key"], (cls << 48) | rank, "right") - 1
            k = rank - table["rank"][i]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table["sequence"][i] + k // table["each"][i]), pa.array(table["slot"][i] + k % table["each"][i])], names=[*kept, "sequence_id", "slot"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name in kept) + ", sequence_id long, slot long"
    placed = ranked.mapInArrow(place, schema)
    offset = F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
