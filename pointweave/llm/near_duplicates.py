"""Near-duplicate documents by DartMinHash signatures, banded joins and exact checks.

Signatures. Darts fall on the plane of (weight, rank) of every shingle, one per unit of area on average, at places that
depend on the shingle alone. A document is hit by the darts below its shingles' weights; each dart belongs to one of k
coordinates, and a coordinate keeps the dart of least rank. Two documents agree on a coordinate with the probability
of their weighted Jaccard similarity. As all shingles of a document share its k coordinates, only about k ln k darts
below a rank bound are needed, whatever the number of shingles; documents with an empty coordinate raise their bound.

Joining. Equal texts are one node. Nodes that agree on a band of coordinates share a bucket. Every node is checked
with its buckets' least nodes (no pairs within a bucket), exactly, on the whole texts' shingles. Links make components.
Nodes that buckets connect make a cluster; a cluster that fits in a tile is a group. Of a larger one, which may be a long
chain of buckets, all nodes that have a bucket with the same least node make a group, which is never such a chain. Small
groups are put together by hash, as far as a tile goes. Where a group has several components, the nodes outside its largest one are compared with all
of the group, exactly, in tiles of bounded size that give only the links that connect components. So every pair that
shares a bucket is checked, or its nodes are in one component already, and no step has a row for each pair.

Hot keys. Rows are counted by key before joins that could be skewed; the few keys that hold more than a thousandth of
the rows each are joined by broadcast, as there are at most a thousand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, worker_memory
from .textscan import Scan, mix64, slices

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
TILE = 512
TILE_SHINGLES = 200_000
#: Cells of the dart board that are looked at once.
CELLS = 1 << 18
#: Shingles with more pairs of entries in a tile are counted by a product of matrices.
OFTEN = 2000
#: A key is hot if it holds more than one in so many rows.
HOT = 1000
#: Bits that stand for a key in the bitmaps of `sifted`, of all keys at most, and of one row.
KEY_BITS = 16
MOST_BITS = 1 << 27
MAP_BITS = 1 << 15
#: How many darts fall on a unit of area: the distribution with mean 1, cumulated.
_POISSON = np.cumsum(np.exp(-1.0) / np.array([math.factorial(i) for i in range(18)], float))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def dart_minhash(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, k: int, seed: int = 1) -> np.ndarray:
    """Signatures of n weighted sets: (n, k) dart ids; sets without weight have zeros.

    elements: 64-bit hashes; owner: each element's set; an element that stands twice in a set counts once, with its
    larger weight.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weights, n)
    todo = np.flatnonzero(total > 0)
    bound = np.zeros(n)
    bound[todo] = (k * math.log(k) + 2 * k) / total[todo]
    with np.errstate(over="ignore"):
        while len(todo):
            mine = np.isin(owner, todo) if len(todo) < n else slice(None)
            own, key, weight = owner[mine], elements[mine], weights[mine]
            # Cells: unit columns of an element's weight by unit strips of rank, as far as its set's bound.
            columns = np.maximum(np.ceil(weight), 1).astype(np.int64)
            strips = np.ceil(bound[own]).astype(np.int64)
            cells = columns * strips
            ends = np.cumsum(cells)
            best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))  # slot, rank and dart, by slot
            for lo in range(0, int(ends[-1]), CELLS):
                index = np.arange(lo, min(lo + CELLS, int(ends[-1])))
                at = np.searchsorted(ends, index, "right")
                number = index - (ends[at] - cells[at])
                column, strip = number // strips[at], number % strips[at]
                cell = mix64(key[at] + mix64((column * 0x1F123BB5 + strip * 0x2545F491 + seed).astype(np.uint64)))
                darts = np.searchsorted(_POISSON, _unit(cell), "right")
                of = np.repeat(np.arange(len(at)), darts)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)
                dart = mix64(cell[of] + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                rank = strip[of] + _unit(dart)
                height = column[of] + _unit(mix64(dart ^ np.uint64(0x5851F42D4C957F2D)))
                hit = (rank < bound[own[at[of]]]) & (height < weight[at[of]])
                dart, rank, mine_of = dart[hit], rank[hit], own[at[of[hit]]]
                slot = mine_of * k + (mix64(dart + np.uint64(0x632BE59BD9B4E019)) % np.uint64(k)).astype(np.int64)
                slot, rank, dart = (np.concatenate(x) for x in zip(best, (slot, rank, dart), strict=True))
                order = np.lexsort((dart, rank, slot))
                order = order[np.flatnonzero(np.diff(slot[order], prepend=-1))]
                best = slot[order], rank[order], dart[order]
            slot, _, dart = best
            out.reshape(-1)[slot] = dart
            full = np.bincount(slot // k, minlength=n) == k
            todo = todo[~full[todo]]
            bound[todo] *= 2
    return out


def shingles(scan: Scan, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every window of `words` words; a text of fewer words is one shingle, one without words none."""
    _, text, h = scan.windows(words)
    short = np.flatnonzero((scan.n_words > 0) & (scan.n_words < words))
    if not len(short):
        return text, h
    w = scan.word_hashes()
    with np.errstate(over="ignore"):
        own = np.array([mix64(np.array([len(v)], np.uint64) + np.bitwise_xor.reduce(mix64(v + np.arange(1, len(v) + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))))[0] for v in (w[scan.first[i] : scan.first[i + 1]] for i in short)], np.uint64)
    return np.concatenate([text, short]), np.concatenate([h, own])


def _counted(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with how often each stands."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.append(first, len(h)))


def signatures(column: pa.Array, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weighting: str = "set") -> np.ndarray:
    """(texts, bands) bucket hashes. weighting "set": a shingle weighs 1; "count": as often as it stands in the text."""
    scan = Scan(column)
    text, h = shingles(scan, words)
    if weighting == "count":
        text, h, n = _counted(text, h)
        weights = n.astype(float)
    else:
        weights = np.ones(len(h))
    order = np.argsort(text, kind="stable")
    text, h, weights = text[order], h[order], weights[order]
    sig = np.zeros((scan.n, bands * rows), np.uint64)
    for lo in range(0, scan.n, 128):  # a set throws some thousand darts
        a, b = np.searchsorted(text, (lo, lo + 128))
        n = min(128, scan.n - lo)
        sig[lo : lo + n] = dart_minhash(h[a:b], text[a:b] - lo, weights[a:b], n, bands * rows)
    sig = sig.reshape(scan.n, bands, rows)
    with np.errstate(over="ignore"):
        out = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
        for r in range(rows):
            out = mix64(out + sig[:, :, r])
    return np.where((scan.n_words > 0)[:, None], out, np.uint64(0))


def similarities(a: pa.Array, b: pa.Array, words: int = WORDS, weighting: str = "set") -> np.ndarray:
    """Exact (weighted) Jaccard similarity of each pair of texts; two texts without words are alike."""
    parts = [_counted(*shingles(Scan(x), words)) for x in (a, b)]
    sizes = [np.bincount(t, n if weighting == "count" else None, len(a)) for t, _, n in parts]
    text, h, n = (np.concatenate([parts[0][i], parts[1][i]]) for i in range(3))
    order = np.lexsort((h, text))
    text, h, n = text[order], h[order], n[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (text[1:] == text[:-1]))
    both = np.bincount(text[same], np.minimum(n[same], n[same + 1]) if weighting == "count" else None, len(a))
    union = sizes[0] + sizes[1] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def content_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def lookup(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows with the columns that facts, one row for each key, has for their key; hot keys go by broadcast."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    hot = F.broadcast(counts.join(F.broadcast(total)).where(F.col("__n") > F.greatest(F.col("__all") / HOT, F.lit(HOT))).select(key))
    few = rows.join(hot, key, "left_semi").join(F.broadcast(facts.join(hot, key, "left_semi")), key, how)
    return rows.join(hot, key, "left_anti").join(facts, key, how).unionByName(few)


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows whose key is among `keys`, and a few others: about one in KEY_BITS, the more the fuller the bitmap gets.

    Places of the keys' hashes in a bitmap of 16 MB at most, which goes by broadcast: rows needn't be shuffled to be
    dropped. An exact join has to follow.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(MAP_BITS, 1 << (KEY_BITS * n).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    part, bit = F.shiftright("__at", 15).alias("__part"), F.col("__at").bitwiseAND(MAP_BITS - 1).alias("__bit")
    # Dealt out before they are put together: else each task would make a row of each part.
    maps = keys.select(place.alias("__at")).select(part, bit).repartition("__part").groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", F.shiftright("__bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    met = rows.withColumn("__at", place).select(*rows.columns, part, bit).join(F.broadcast(maps), "__part")
    return met.where(F.getbit(byte, F.col("__bit").bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of an edge is connected with.

    Large and small stars in turn: every node's greater neighbours, then its lesser ones, are tied to its least
    neighbour, until all edges run from a node without another edge to its least one, which a further round wouldn't
    change; labels only fall, so that comes to an end. Nothing is collected; each round is written to the shared folder
    and the one before deleted. A hub's edges are one key of a plain join, which adaptive execution splits, and are
    counted or reduced to a minimum before they are shuffled otherwise. No join is by broadcast, at any size: the driver
    would keep a table for each join of each round.
    """
    scratch = Scratch(edges.sparkSession)
    e, last = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: all edges run from the greater to the lesser node here.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        e = scratch.write(small, "components")
        if last is not None:
            scratch.drop(last)
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(None).cast("int").alias("up")))
        if ends.groupBy("x").agg(F.count("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 0 and n > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = e


def _check(pairs: DataFrame, texts: DataFrame, words: int, least: float, weighting: str) -> DataFrame:
    """Those pairs (a, b) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        for batch in batches:
            for lo, hi in slices(batch.column(2), 1 << 20):
                part = batch.slice(lo, hi - lo)
                good = similarities(part.column(2), part.column(3), words, weighting) >= least - 1e-12
                yield part.select(["a", "b"]).filter(pa.array(good))

    # Texts grow with the corpus, and so do pairs: neither side is ever broadcast.
    of_a, of_b = texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    return pairs.join(of_a.hint("merge"), "a").join(of_b.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def cross_links(first: pa.Array, second: pa.Array, comp_a: list, comp_b: list, words: int, least: float, weighting: str) -> list[tuple[int, int]]:
    """(place in first, place in second) of similar texts that connect different components; only as many as connect.

    Similarities are exact: all shingles that both sides have are counted for all pairs.
    """
    (ta, ha, na), (tb, hb, nb) = (_counted(*shingles(Scan(x), words)) for x in (first, second))
    if weighting != "count":
        na, nb = np.ones(len(ta), np.int64), np.ones(len(tb), np.int64)
    size_a, size_b = np.bincount(ta, na, len(first)), np.bincount(tb, nb, len(second))
    common = np.intersect1d(ha, hb)
    both = np.zeros(len(first) * len(second))
    keep_a, keep_b = np.isin(ha, common), np.isin(hb, common)
    ca, cb = np.searchsorted(common, ha[keep_a]), np.searchsorted(common, hb[keep_b])
    ra, rb, wa, wb = ta[keep_a], tb[keep_b], na[keep_a], nb[keep_b]
    times_b = np.bincount(cb, minlength=len(common))
    often = np.bincount(ca, minlength=len(common)) * times_b > OFTEN
    # Rare shingles: each of the first side's entries meets the second's of the same shingle.
    some = np.flatnonzero(~often[ca])
    order = np.argsort(cb, kind="stable")
    begin = np.cumsum(times_b) - times_b
    ends = np.cumsum(times_b[ca[some]])
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
        entry = some[lo:hi]
        n = times_b[ca[entry]]
        other = order[np.repeat(begin[ca[entry]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        entry = np.repeat(entry, n)
        both += np.bincount(ra[entry].astype(np.int64) * len(second) + rb[other], np.minimum(wa[entry], wb[other]), len(both))
        lo = hi
    both = both.reshape(len(first), len(second))
    # Frequent ones are columns of two matrices, whose product counts them.
    place = np.cumsum(often) - 1
    many_a, many_b = often[ca], often[cb]
    ca, ra, wa, cb, rb, wb = place[ca[many_a]], ra[many_a], wa[many_a], place[cb[many_b]], rb[many_b], wb[many_b]
    for lo in range(0, int(often.sum()), 4096):
        ma, mb = ((c >= lo) & (c < lo + 4096) for c in (ca, cb))
        top = int(max(wa[ma].max(initial=1), wb[mb].max(initial=1)))
        for level in range(1, top + 1):  # the sum over levels of "has at least so many" products is the sum of minima
            x, y = np.zeros((len(first), 4096), np.float32), np.zeros((len(second), 4096), np.float32)
            x[ra[ma], ca[ma] - lo] = wa[ma] >= level
            y[rb[mb], cb[mb] - lo] = wb[mb] >= level
            both += x @ y.T
    union = size_a[:, None] + size_b[None, :] - both
    hits = np.argwhere((both >= (least - 1e-12) * union) & (union > 0))
    parent: dict = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for i, j in hits:
        a, b = root(comp_a[i]), root(comp_b[j])
        if a != b:
            parent[a] = b
            out.append((int(i), int(j)))
    return out


def _tiled_links(shared: DataFrame, found: DataFrame, texts: DataFrame, words: int, least: float, weighting: str, scratch: Scratch) -> DataFrame:
    """Links (a, b) within groups beyond those found: nodes outside a group's largest component against all of it."""
    ties = shared.where("key != leader").select(F.col("key").alias("a"), F.col("leader").alias("b"))
    cluster = components(ties).select(F.col("node").alias("key"), F.col("component").alias("s"))
    # Texts of a group are counted in words, about; that bounds what a tile holds.
    node = texts.select("key", (F.length("text") / 4).cast("long").alias("weight")).join(found.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "weight", F.coalesce("component", "key").alias("c"))
    node = scratch.write(node.join(cluster, "key", "left").select("key", "weight", "c", F.coalesce("s", "key").alias("cluster")), "dup-clusters")
    size = node.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.min("c").alias("least"), F.max("c").alias("most"))
    size = scratch.write(size.where("least != most").select("cluster", ((F.col("n") <= TILE) & (F.col("w") <= TILE_SHINGLES)).alias("small")), "dup-sizes-of-clusters")
    open_ = scratch.write(lookup(node, size, "cluster"), "dup-open")
    scratch.drop(node)
    large = shared.join(open_.where("not small").select("key", "weight", "c"), "key").select("key", F.col("leader").alias("s"), "weight", "c")
    member = scratch.write(open_.where("small").select("key", F.col("cluster").alias("s"), "weight", "c").unionByName(large), "dup-members")
    group = member.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    group = scratch.write(group.withColumn("small", (F.col("n") <= TILE / 2) & (F.col("w") <= TILE_SHINGLES / 2)), "dup-groups")
    all_ = group.where("small").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    bins = max(1, math.ceil(all_["n"] / (TILE * 0.8)), math.ceil(all_["w"] / (TILE_SHINGLES * 0.8)))
    put = F.when(F.col("small"), F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64("s"), F.lit(bins))), 16, "0"))).otherwise(F.col("s"))
    node = scratch.write(lookup(member, group.select("s", put.alias("bin")), "s").select("key", "weight", "c", F.col("bin").alias("s")).distinct(), "dup-binned")
    scratch.drop(size, open_, member, group)
    per = node.groupBy("s", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    whole = per.groupBy("s").agg(F.count(F.lit(1)).alias("parts"), F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("n").alias("main_n"), F.max_by("w", F.struct("n", "c")).alias("main_w")).where("parts > 1")
    tiles = lambda n, w: F.greatest(F.ceil(n / TILE), F.ceil(w / TILE_SHINGLES), F.lit(1)).cast("int")
    whole = scratch.write(whole.select("s", "main", tiles(F.col("n"), F.col("w")).alias("all_tiles"), tiles(F.col("n") - F.col("main_n"), F.col("w") - F.col("main_w")).alias("out_tiles")), "dup-tiles")
    member = lookup(node, whole, "s")
    spread = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = member.where("c != main").select("s", spread("out_tiles").alias("i"), every("all_tiles").alias("j"), F.lit(True).alias("out"), "key", "c")
    right = member.select("s", every("out_tiles").alias("i"), spread("all_tiles").alias("j"), F.lit(False).alias("out"), "key", "c")
    rows = left.unionByName(right).join(texts.hint("merge"), "key").select("s", "i", "j", "out", "key", "c", "text")

    def run(group: pa.Table) -> pa.Table:
        worker_memory(())
        out = group.column("out").to_numpy()
        one, two = group.filter(pa.array(out)).combine_chunks(), group.filter(pa.array(~out)).combine_chunks()
        flat = lambda t: pa.concat_arrays(t.column("text").chunks) if t.num_rows else pa.array([], pa.string())
        links = cross_links(flat(one), flat(two), one.column("c").to_pylist(), two.column("c").to_pylist(), words, least, weighting) if one.num_rows and two.num_rows else []
        a, b = one.column("key").to_pylist(), two.column("key").to_pylist()
        return pa.table({"a": pa.array([a[i] for i, _ in links], pa.binary()), "b": pa.array([b[j] for _, j in links], pa.binary())})

    # A tile takes long for its bytes, by which adaptive execution would put tiles together; a named number stays.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s", "i", "j")
    links = scratch.write(rows.groupBy("s", "i", "j").applyInArrow(run, "a binary, b binary"), "dup-links2")
    scratch.drop(node, whole)
    return links


def classes(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighting: str = "set") -> DataFrame:
    """One row for each row of docs: doc_id, key (of its text), class_key, class_id, class_size.

    class_id is the least doc_id of the documents connected by links of the similarity; null only if all their ids
    are. Null texts count as empty; empty texts are one class, other texts without words are classes by equal text.
    Whole texts count, whatever their length. Repeated rows and ids are rows of their own; other columns are ignored;
    an empty table gives an empty result.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        for batch in batches:
            for lo, hi in slices(batch.column(2), 1 << 19):
                part = batch.slice(lo, hi - lo)
                sig = signatures(part.column(2), words, bands, rows, weighting).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, bands), pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat], names=["doc_id", "key", "bands"])

    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key(F.col("text")).alias("key"), "text")
    signed = scratch.write(keyed.mapInArrow(sign, "doc_id long, key binary, bands array<long>"), "dup-signatures")
    nodes = scratch.write(signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")), "dup-nodes")
    banded = nodes.select("key", F.explode("bands").alias("h")).where("h != 0")
    buckets = scratch.write(banded.groupBy("h").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "leader"), "dup-buckets")
    # A row for each node and leader, not for each bucket that they share.
    shared = scratch.write(lookup(banded, buckets, "h").select("key", "leader").distinct(), "dup-shared")
    first = shared.where("key != leader").select(F.col("key").alias("a"), F.col("leader").alias("b"))
    # Only texts that share a bucket are shuffled, equal ones as one row.
    alike = shared.select("key").distinct()
    texts = sifted(keyed.select("key", F.coalesce("text", F.lit("")).alias("text")), alike, "key").groupBy("key").agg(F.first("text").alias("text"))
    texts = scratch.write(texts.join(alike, "key", "left_semi"), "dup-texts")
    links = scratch.write(_check(first, texts, words, least, weighting), "dup-links")
    found = components(links)
    more = _tiled_links(shared, found, texts, words, least, weighting, scratch)
    if not more.isEmpty():
        # Components, not nodes, are connected now: found ones stand for their links.
        found = components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    whole = nodes.select("key", "doc_id", "n").join(found, F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("class_key"), "doc_id", "n")
    whole = scratch.write(whole, "dup-classes")
    per_class = scratch.write(whole.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size")), "dup-sizes")
    scratch.drop(buckets, shared, texts, links, more, nodes)
    of_key = scratch.write(lookup(whole.select("key", "class_key"), per_class, "class_key"), "dup-keys")
    scratch.drop(whole, per_class)
    return lookup(signed.select("doc_id", "key"), of_key, "key").select("doc_id", "key", "class_key", "class_id", "class_size")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with docs' columns: that of the least doc_id (null ids last, then by text).

    Of repeated rows of that id and text the one with the least hash of its columns stays. What holds for classes()
    holds here: null texts are empty, an empty table gives an empty one, and columns of any name stay as they are.
    """
    member = classes(docs, **options)
    choice = member.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("m"))
    keep = choice.select(F.coalesce(F.col("m.doc_id").cast("string"), F.lit("-")).alias("id"), F.col("m.key").alias("key"))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("id"), content_key(F.col("text")).alias("key"), F.struct(*docs.columns).alias("row"), F.xxhash64(*plain).alias("order"))
    one = keyed.groupBy("id", "key").agg(F.min_by("row", "order").alias("row"))  # repeated rows are one before the shuffle
    return one.join(keep, ["id", "key"], "left_semi").select("row.*")
