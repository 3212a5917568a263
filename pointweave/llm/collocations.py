"""Phrases that stand more often than their parts would by chance: frequent word n-grams of each language, scored.

Frequent words get numbers from 1 on; all others, and punctuation, break a text into pieces. A window of five numbers from
each place on (zeros behind a piece's end) is a binary key of fixed width, two to four bytes for each number, big-endian,
so that keys sort as their numbers do. Equal windows of a slice are one key with a count. Keys are dealt out by ranges and
sorted (Spark's sort compares eight bytes of a key at once, by radix); in that order every phrase of two to five words is a
run of keys with one beginning, so run lengths count all phrases. A run that ends with a batch of keys may go on in the
next, so the first and the last run of each length are added up over batches, and all others are whole.

No phrase is more frequent than its words, so phrases of the wanted frequency have frequent words only. The numbered words
go to all tasks by broadcast while their text is below a bound (`most_bytes`); more are joined to the words of the texts
instead, with the same results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, worker_memory
from .near_duplicates import lookup
from .textscan import Scan, slices
from .url_filter import lower

#: Words of a phrase at most, its least frequency, results of a language, and the frequency of a longer
#: phrase, in percent of a shorter one's, with which it stands for it.
WORDS, LEAST, FIRST, ABSORB = 5, 100, 2000, 100
#: Text of frequent words that one broadcast may hold.
MOST_BYTES = 64 << 20
#: Bytes of text that are read at once.
SLICE = 1 << 21
#: In how many parts words get their numbers.
PARTS = 1024
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE = _BREAKS.copy()
_SPACE[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
BREAKS, WORD = r"[.,;:!?\x0A-\x0D]", r"[^\x20\x09]+"


class Words:
    """The words of a slice of texts, in small letters: codes into `values`, and where pieces begin."""

    def __init__(self, column: pa.Array):
        s = Scan(column, _SPACE)
        n = len(s.starts)
        self.first_of_piece = np.zeros(n + 1, bool)
        self.first_of_piece[s.first] = True
        if n:
            self.first_of_piece[np.searchsorted(s.starts, np.flatnonzero(_BREAKS[s.data]))] = True
        size = np.zeros(n + 1, np.int64)
        np.cumsum(s.ends - s.starts, out=size[1:])
        flat = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(size), pa.py_buffer(_FOLD[s.data[s.word]])])
        coded = flat.dictionary_encode()
        self.codes, self.values = coded.indices.to_numpy(), coded.dictionary


def _lang(lang: Column) -> Column:
    return F.coalesce(lang, F.lit("und"))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) of a batch, in slices."""
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        texts = batch.column("text").filter(pc.equal(langs, lang))
        for lo, hi in slices(texts, SLICE):
            yield lang, texts.slice(lo, hi - lo)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): how often each word stands in the texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        for batch in batches:
            for lang, texts in _by_lang(batch):
                w = Words(texts)
                n = np.bincount(w.codes, minlength=len(w.values))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), w.values.cast(pa.large_string()).cast(pa.string()), pa.array(n)], names=["lang", "word", "n"])

    each = docs.select(_lang(F.col("lang")).alias("lang"), "text").mapInArrow(run, "lang string, word string, n long")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("f"))


def numbered(counts: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, f): numbers from 1 on for the words of at least that frequency, the same in every run."""
    often = counts.where(F.col("f") >= least).withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(PARTS)).cast("int"))
    sizes = often.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # PARTS rows at most
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.broadcast(sizes.select("part", before.alias("before")))
    own = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    return often.withColumn("own", own).join(at, "part").select((F.col("before") + F.col("own")).cast("int").alias("id"), "lang", "word", "f")


def windows(ids: np.ndarray, fresh: np.ndarray, width: int) -> tuple[pa.Array, np.ndarray]:
    """(keys in order, count of each) of the windows of two numbers or more. ids: 0 where a word isn't numbered."""
    n = len(ids)
    x = np.zeros((WORDS, n), np.uint32)
    x[0] = ids
    for k in range(1, WORDS):  # as long as the piece goes on and all words are numbered
        on = (x[k - 1, : n - k] > 0) & ~fresh[k:n]
        x[k, : n - k][on] = ids[k:n][on]
    x = x[:, x[1] > 0]
    bits, packed = 8 * width, []
    for lo in range(0, WORDS, 64 // bits):
        part = x[lo : lo + 64 // bits].astype(np.uint64)
        key = np.zeros(x.shape[1], np.uint64)
        for row in part:
            key = (key << np.uint64(bits)) | row
        packed.append(key << np.uint64(bits * (64 // bits - len(part))))
    order = np.argsort(packed[0])
    tied = np.zeros(len(order) + 1, bool)
    tied[1:-1] = packed[0][order[1:]] == packed[0][order[:-1]]
    tied = np.flatnonzero(tied[:-1] | tied[1:])
    order[tied] = order[tied][np.lexsort([p[order[tied]] for p in reversed(packed)])]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([p[order[1:]] != p[order[:-1]] for p in packed], axis=0)
    at = np.flatnonzero(new)
    x = np.ascontiguousarray(x[:, order[at]].T)
    raw = x.astype(">u4").view(np.uint8).reshape(len(at), WORDS, 4)[:, :, 4 - width :]
    return pa.Array.from_buffers(pa.binary(WORDS * width), len(at), [None, pa.py_buffer(np.ascontiguousarray(raw))]), np.diff(np.append(at, len(order)))


def _keys_by_broadcast(docs: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """(key, n) of the windows, with the numbered words in each task."""
    spark = docs.sparkSession
    known = words.select("lang", "word", "id").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as out:
        out.write_table(known)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    token = ("collocations", uuid.uuid4().hex)

    def load() -> dict:
        table = pa.ipc.open_stream(shared.value).read_all()
        return {lang: (part["word"].combine_chunks().cast(pa.large_binary()), part["id"].to_numpy()) for lang in pc.unique(table["lang"]).to_pylist() for part in [table.filter(pc.equal(table["lang"], lang))]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_memory(token, load)
        for batch in batches:
            for lang, texts in _by_lang(batch):
                if lang not in table:
                    continue
                w = Words(texts)
                if not len(w.codes):
                    continue
                values, ids = table[lang]
                place = pc.index_in(w.values, values).fill_null(len(ids)).to_numpy()
                key, n = windows(np.append(ids, 0)[place][w.codes], w.first_of_piece[:-1], width)
                yield pa.RecordBatch.from_arrays([key.cast(pa.binary()), pa.array(n.astype(np.int32))], names=["key", "n"])

    return docs.select(_lang(F.col("lang")).alias("lang"), "text").mapInArrow(run, "key binary, n int")


def _keys_by_join(docs: DataFrame, words: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """The same, with the numbered words joined to the texts' words."""
    pieces = F.posexplode(F.split(lower(F.coalesce("text", F.lit(""))), BREAKS))
    # Written once, so that a piece keeps its number.
    cut = scratch.write(docs.select(_lang(F.col("lang")).alias("lang"), "text").select("lang", pieces.alias("at", "piece")).select(F.monotonically_increasing_id().alias("p"), "lang", "piece"), "phrase-pieces")
    each = cut.select("p", "lang", F.posexplode(F.regexp_extract_all("piece", F.lit(WORD), F.lit(0))).alias("at", "word")).select("p", "at", F.struct("lang", "word").alias("w"))
    coded = lookup(each, words.select(F.struct("lang", "word").alias("w"), "id"), "w", "left").select("p", "at", F.coalesce("id", F.lit(0)).alias("id"))
    rows = coded.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda r: r["id"]).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        for batch in batches:
            lists = batch.column(0)
            ids = lists.flatten().to_numpy()
            fresh = np.zeros(len(ids) + 1, bool)
            fresh[lists.offsets.to_numpy() - lists.offsets[0].as_py()] = True
            key, n = windows(ids, fresh[:-1], width)
            yield pa.RecordBatch.from_arrays([key.cast(pa.binary()), pa.array(n.astype(np.int32))], names=["key", "n"])

    return rows.select("ids").mapInArrow(run, "key binary, n int")


def phrase_counts(keys: DataFrame, width: int, least: int) -> DataFrame:
    """(key, f): phrases of two words or more of at least that frequency, as keys with zeros behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory(())
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            column = batch.column(0)
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            raw = np.frombuffer(column.buffers()[2], np.uint8)[at : at + m * WORDS * width].reshape(m, WORDS, width)
            times = batch.column(1).to_numpy().astype(np.int64)
            same = np.cumprod((raw[1:] == raw[:-1]).all(axis=2), axis=1).sum(axis=1)  # numbers shared with the row before
            length = (raw != 0).any(axis=2).sum(axis=1)
            for k in range(2, WORDS + 1):
                begin = np.concatenate([[0], np.flatnonzero(same < k) + 1])
                f = np.add.reduceat(times, begin)
                whole = length[begin] >= k  # else the window ends before
                keep = f >= least
                keep[[0, -1]] = True
                rows = begin[keep & whole]
                out = raw[rows].copy()
                out[:, k:] = 0
                out = pa.Array.from_buffers(pa.binary(WORDS * width), len(rows), [None, pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([out.cast(pa.binary()), pa.array(f[keep & whole])], names=["key", "n"])

    ranged = keys.repartitionByRange(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    return ranged.mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def phrases(docs: DataFrame, least: int = LEAST, first: int = FIRST, absorb: int = ABSORB, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    a, l, r: frequency of the phrase and of the two parts of its worst cut; n: words of the language; score:
    floor(1000 a n / (l r)). Phrases that a longer one holds, with absorb percent of its frequency or more, are left out.
    Null texts count as empty, a null lang as "und"; whole texts count, whatever their length, and repeated rows each
    time. Ids aren't needed; other columns are ignored. An empty table gives an empty result. Words of more than 2^31
    bytes aren't possible in a row.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.write(word_counts(docs), "phrase-words")
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = scratch.write(numbered(counts, least), "phrase-numbers")
    size = words.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang") + 8), F.lit(0)).alias("b"), F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()
    width = 2 if size["top"] < 1 << 16 else 3 if size["top"] < 1 << 24 else 4
    keys = _keys_by_broadcast(docs, words, width) if size["b"] <= most_bytes else _keys_by_join(docs, words, width, scratch)
    found = scratch.write(phrase_counts(keys, width, least), "phrase-counts")

    number = lambda key, k: F.conv(F.hex(F.substring(key, k * width + 1, width)), 16, 10).cast("int")
    part = lambda key, k, m: F.rpad(F.substring(key, k * width + 1, m * width), WORDS * width, F.lit(b"\x00"))
    ones = words.select(F.rpad(F.unhex(F.lpad(F.hex(F.col("id").cast("long")), 2 * width, "0")), WORDS * width, F.lit(b"\x00")).alias("key"), "f")
    f = ones.unionByName(found)
    length = sum(F.when(number(F.col("key"), k) > 0, 1).otherwise(0) for k in range(WORDS))
    candidates = found.select("key", F.col("f").alias("a"), length.alias("m"))
    # What a longer phrase stands for: all parts of two words or more.
    inside = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), part(F.col("key"), k, m).alias("key")) for m in range(2, WORDS) for k in range(WORDS - m + 1)])
    longer = candidates.where("m > 2").select("a", F.col("m").alias("whole"), F.explode(inside).alias("p")).where("p.m < whole and p.k + p.m <= whole")
    longest = longer.groupBy(F.col("p.key").alias("key")).agg(F.max("a").alias("longer"))
    free = candidates.join(longest, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a"))).select("key", "a", "m")
    # All cuts; the worst one counts.
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), part(F.col("key"), 0, k).alias("left"), part(F.col("key"), k, WORDS - k).alias("right")) for k in range(1, WORDS)])
    each = free.select("key", "a", "m", F.explode(cuts).alias("c")).where("c.k < m").select("key", "a", F.col("c.k").alias("k"), F.col("c.left").alias("left"), F.col("c.right").alias("right"))
    # Plain joins, as these are phrases, not words of texts: adaptive execution splits the keys of common words.
    each = each.join(f.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(f.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    each = each.withColumn("one", number(F.col("key"), 0)).join(words.select(F.col("id").alias("one"), "lang"), "one").join(total, "lang")
    each = each.withColumn("score", F.expr("(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) * 1000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    worst = each.groupBy("lang", "key", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w")).select("lang", "key", "a", "n", "w.l", "w.r", "w.score")
    # Equals of the last place stay until phrases are spelt, which decides between them.
    top = worst.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= first).drop("place")
    top = scratch.write(top, "phrase-top")
    spelt = top.select("key", F.posexplode(F.array(*[number(F.col("key"), k) for k in range(WORDS)])).alias("at", "id")).where("id > 0").join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    out = top.join(spelt, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= first)
    scratch.drop(counts, found)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
