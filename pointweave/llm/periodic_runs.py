"""Periodic runs of words: maximal stretches that repeat their first words over and over.

Method of Stoye and Gusfield on the suffix tree of each document's words. Leaves i and i + d below a node of depth d are a
tandem repeat; it is branching if the words after its halves differ. At each node only the leaves outside the largest
child are looked at, as each branching repeat there has a leaf in another child than its partner's. So a leaf is looked at
once for each halving of a subtree, n log n times in all. Branching repeats are rotated to the left as long as they
repeat, which gives the maximal stretch of that period; of equal stretches the one of the smallest period stays.

The tree is held as arrays: sorted suffixes, the depths of the nodes between neighbours (longest common prefixes), and
for each of these the node's bounds (nearest smaller depths on both sides). A batch of documents is one forest, as the
first word's number tells documents apart. Most suffixes differ after a few words, so most steps go over whole arrays;
only what is left after some rounds, inside long repeats, is walked one by one, in linear time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import worker_memory
from .textscan import Scan, slices

#: A run has at least so many words, and at least so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Rounds over whole arrays before what is left is walked one by one.
ROUNDS = 8
#: Leaves of a forest that are looked at once.
LEAVES = 1 << 19
#: Bytes of text whose forest is built at once (a longer text alone).
SLICE = 1 << 19


def sorted_suffixes(first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, place of each suffix), by doubling the compared width for those that aren't told apart yet.

    first: each position's first word, different in different documents; ends: where each position's document ends. A
    suffix that is the beginning of another one comes before it.
    """
    n = len(first)
    order = np.argsort(first, kind="stable").astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    alone = new.copy()
    alone[:-1] &= new[1:]
    open_ = np.flatnonzero(~alone).astype(np.int32)  # places in order that share a rank with a neighbour
    width = 1
    while len(open_):
        at = order[open_]
        further = at.astype(np.int64) + width
        key = rank[at].astype(np.int64) * (n + 1)
        inside = further < ends[at]
        key[inside] += rank[further[inside]].astype(np.int64) + 1
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = open_[~alone]
        width *= 2
    return order, rank


def common_prefixes(words: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each place in order: how many words its suffix shares with the one before it (0 at the first).

    words differ between documents, so no suffix is compared beyond its document.
    """
    n = len(words)
    depth = np.zeros(n, np.int32)
    left = np.arange(1, n, dtype=np.int32)  # places still equal with the one before
    for k in range(ROUNDS):
        a, b = order[left - 1] + k, order[left] + k
        same = (a < ends[order[left - 1]]) & (b < ends[order[left]])
        same[same] = words[a[same]] == words[b[same]]
        left = left[same]
        depth[left] = k + 1
        if not len(left):
            return depth
    # In text order each suffix shares at most one word less than the one before it in the text did.
    at = np.sort(order[left])
    text, in_order, stop, out = (memoryview(x) for x in (words, order, ends, depth))
    before, m = -2, 0
    for lo in range(0, len(at), 1 << 16):
        part = at[lo : lo + (1 << 16)]
        for i, place in zip(part.tolist(), rank[part].tolist(), strict=True):
            j = in_order[place - 1]
            m = max(m - 1, ROUNDS) if i == before + 1 else ROUNDS
            most = min(stop[i] - i, stop[j] - j)
            while m < most and text[i + m] == text[j + m]:
                m += 1
            out[place] = m
            before = i
    return depth


def smaller_before(depth: np.ndarray) -> np.ndarray:
    """For each place with a depth over 0: the nearest place before it of smaller depth. Place 0 has depth 0."""
    to = np.arange(-1, len(depth) - 1, dtype=np.int32)
    left = np.flatnonzero(depth > 0)
    for _ in range(ROUNDS):
        left = left[depth[to[left]] >= depth[left]]
        if not len(left):
            return to
        to[left] = to[to[left]]
    walk, height = memoryview(to), memoryview(np.ascontiguousarray(depth))
    for lo in range(0, len(left), 1 << 16):  # all others, and those before it, point to their smaller one already
        for i in left[lo : lo + (1 << 16)].tolist():
            p, h = walk[i], height[i]
            while height[p] >= h:
                p = walk[p]
            walk[i] = p
    return to


def branching_repeats(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching tandem repeats: words[i:i+p] == words[i+p:i+2p], and the words at i + p and i + 2p
    differ, or the document ends there. words differ between documents.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    order, rank = sorted_suffixes(words, ends)
    depth = common_prefixes(words, ends, order, rank)
    low = smaller_before(depth)
    # The same from the other side: a place's depth lies between the leaves before and after it.
    high = n - smaller_before(np.append(depth[1:], 0)[::-1])[::-1]
    high = np.concatenate([[0], high[:-1]]).astype(np.int32)  # of place k: the first leaf behind its node
    inner = np.flatnonzero(depth > 0)
    if not len(inner):
        return none, none
    # The places of a node cut its leaves into its children.
    inner = inner[np.lexsort((inner, depth[inner], low[inner]))]
    p, d = low[inner], depth[inner]
    begins = np.ones(len(inner), bool)
    begins[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
    lasts = np.append(begins[1:], True)
    # Children: one that ends at each place, and the last one, that ends with the node.
    node = np.cumsum(begins) - 1
    starts = np.concatenate([np.where(begins, p, np.concatenate([[0], inner[:-1]])), inner[lasts]])
    stops = np.concatenate([inner, high[inner[lasts]]])
    of = np.concatenate([node, node[lasts]])
    lo, hi, deep = p[begins], high[inner[begins]], d[begins]
    size = stops - starts
    sort = np.lexsort((-size, of))
    largest = np.zeros(len(of), bool)
    largest[sort[np.flatnonzero(np.diff(of[sort], prepend=-1))]] = True
    starts, size, of = starts[~largest], size[~largest], of[~largest]
    total = np.cumsum(size)
    found = []
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LEAVES, "right")))
        s, v = size[at:end], np.repeat(of[at:end], size[at:end])
        leaf = order[np.repeat(starts[at:end], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)].astype(np.int64)
        for sign in (1, -1):  # the leaf is the left or the right half's beginning
            i = leaf if sign > 0 else leaf - deep[v]
            j = i + deep[v]
            ok = (i >= 0) & (j < n)
            i, j, k = i[ok], j[ok], v[ok]
            other = rank[j if sign > 0 else i]
            ok = (other >= lo[k]) & (other < hi[k])
            i, j, per = i[ok], j[ok], deep[k[ok]].astype(np.int64)
            after = j + per
            ok = after >= ends[i]
            ok[~ok] = words[j[~ok]] != words[after[~ok]]
            found.append(np.stack([i[ok], per[ok]], axis=1))
        at = end
    got = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return got[:, 0], got[:, 1]


def maximal_runs(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. begins, ends: of each position's document."""
    start, period = branching_repeats(words, ends)
    # Most repeats are too short for a run; a look at the words before them shows it.
    for k in range(1, 5):
        need = np.maximum(LEAST_WORDS, LEAST_TIMES * period) - 2 * period >= k
        ok = ~need | (start - k >= begins[start])
        look = np.flatnonzero(need & ok)
        ok[look] = words[start[look] - k] == words[start[look] - k + period[look]]
        start, period = start[ok], period[ok]
    runs: dict[int, list[tuple[int, int]]] = {}
    out = []
    order = np.argsort(period, kind="stable")
    for i, p in zip(start[order].tolist(), period[order].tolist(), strict=True):
        end, low = i + 2 * p, int(begins[i])
        known = runs.setdefault(end, [])
        if any(p % q == 0 and s <= i for s, q in known):  # several times a smaller period, so the same stretch
            continue
        step = 16
        while i > low:  # rotate to the left
            m = min(step, i - low)
            differ = np.flatnonzero(words[i - m : i] != words[i - m + p : i + p])
            if len(differ):
                i -= m - 1 - int(differ[-1])
                break
            i -= m
            step = min(step * 2, 1 << 16)
        known.append((i, p))
        if end - i >= max(LEAST_WORDS, LEAST_TIMES * p):
            out.append((i, end - i, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered_words(scan: Scan) -> np.ndarray:
    """A number for each word of the texts: equal for equal words of one text, different in different texts."""
    n = len(scan.starts)
    if not n:
        return np.zeros(0, np.int32)
    size = np.zeros(n + 1, np.int64)
    np.cumsum(scan.ends - scan.starts, out=size[1:])
    flat = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(size), pa.py_buffer(scan.data[scan.word])])
    code = flat.dictionary_encode().indices.to_numpy()
    top = int(code.max()) + 1
    kind = np.int32 if top * scan.n < 1 << 31 else np.int64
    return code.astype(kind) + np.repeat(np.arange(scan.n, dtype=kind), scan.n_words) * kind(top)


OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def measure(column: pa.Array, collapsed: bool = False, spans: bool = False) -> dict[str, list]:
    """Columns of OUT for each text; with collapsed=True also the kept words, with spans=True also all runs."""
    s = Scan(column)
    words, at = numbered_words(s), s.first
    begins, ends = (np.repeat(x, s.n_words).astype(np.int32) for x in (at[:-1], at[1:]))
    runs: list[list] = [[] for _ in range(s.n)]
    dropped = np.zeros(len(words) + 1, np.int32)
    for i, length, p in maximal_runs(words, begins, ends):
        text = int(np.searchsorted(at, i, "right")) - 1
        runs[text].append((i - int(at[text]), length, p))
        dropped[i + p] += 1
        dropped[i + length] -= 1
    keep = np.cumsum(dropped[:-1]) == 0
    # Kept words with the byte after each of them, a space, but for a text's last.
    stay = s.word.copy()
    for w in np.flatnonzero(~keep):
        stay[s.starts[w] : s.ends[w]] = False
    shown = np.flatnonzero(keep)
    more = np.flatnonzero(np.append(begins[shown[1:]] == begins[shown[:-1]], False)) if len(shown) else shown
    stay[s.ends[shown[more]]] = True
    data = np.where(s.word, s.data, np.uint8(0x20))[stay]
    cut = np.concatenate([[0], np.cumsum(stay, dtype=np.int64)])[s.at]
    parts = [data[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    best = [_greatest(r) for r in runs]
    out = {
        "n_runs": [len(r) for r in runs],
        "start": [b and b[0] for b in best],
        "length": [b and b[1] for b in best],
        "period": [b and b[2] for b in best],
        "exponent_milli": [b and 1000 * b[1] // b[2] for b in best],
        "runs_sha256": [hashlib.sha256("".join(f"{i},{n},{p}\n" for i, n, p in r).encode()).hexdigest() for r in runs],
        "collapsed_sha256": [hashlib.sha256(p).hexdigest() for p in parts],
    }
    if collapsed:
        out["collapsed"] = [p.decode() for p in parts]
    if spans:
        out["runs"] = [[{"start": i, "length": n, "period": p} for i, n, p in r] for r in runs]
    return out


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period, the first of equals; runs come by start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def find_runs(docs: DataFrame, collapsed: bool = False, spans: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, the columns of OUT; with collapsed=True also the text without repeats, with
    spans=True also the list of all runs (start, length, period).

    A run is a stretch of words of smallest period q, of at least 6 words and 4 q, that no neighbouring word extends. A
    word is dropped from the collapsed text if a run has it behind its first q words. Null texts count as empty: no runs,
    four nulls. Whole texts count, whatever their length: memory is about 120 bytes for each word of the longest. Repeated
    rows and null ids are rows of their own, other columns are ignored, an empty table gives an empty result.
    """
    names = [f.split()[0] for f in OUT.split(", ")] + ["collapsed"] * collapsed + ["runs"] * spans
    kinds = {c: pa.string() if "sha" in c or c == "collapsed" else pa.int64() for c in names} | ({"runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))} if spans else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE):
                part = batch.slice(lo, hi - lo)
                got = measure(part.column(1), collapsed, spans)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(got[c], kinds[c]) for c in names]], names=["doc_id", *names])

    more = (", collapsed string" if collapsed else "") + (", runs array<struct<start:long,length:long,period:long>>" if spans else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {OUT}{more}")
