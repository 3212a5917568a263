"""Token ids in a binary format: byte planes of fixed-size blocks, each plane compressed, with an index.

A container holds the ids of some whole documents. They are cut into blocks of a fixed number of ids; the ids'
lowest bytes, second bytes and so on of a block form a plane each, as equal bytes stand together there; each plane is
compressed by zstandard. The index tells where each plane lies, so any range of ids is read without the rest.

Layout, little-endian: 8 bytes of magic; block size, blocks, planes (uint32 each), ids (uint64); then
(blocks * planes + 1) plane offsets (uint64) from the end of the index; then the planes.

A store is a table of containers in document order: part, chunk, start_in_part, n_ids, doc_ids, doc_lengths, container.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import new_path
from .encode import encoder as worker_encoder
from .textscan import slices

MAGIC = b"PWPLANE1"
BLOCK = 16_384
PLANES = 4
CHUNK = 1 << 18
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
_HEAD = struct.Struct("<8sIIIQ")


def write_container(ids: np.ndarray, block: int = BLOCK, level: int = 1) -> bytes:
    raw = np.ascontiguousarray(ids, dtype="<u4")
    press = zstandard.ZstdCompressor(level=level).compress
    planes = []
    for lo in range(0, len(raw), block):
        shuffled = np.ascontiguousarray(raw[lo : lo + block].view(np.uint8).reshape(-1, PLANES).T)
        planes += [press(shuffled[p].tobytes()) for p in range(PLANES)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in planes])]).astype("<u8")
    return _HEAD.pack(MAGIC, block, len(planes) // PLANES, PLANES, len(raw)) + offsets.tobytes() + b"".join(planes)


def read_container(data: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids lo to hi of a container; only the blocks that hold them are decompressed."""
    magic, block, blocks, planes, n = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a container of token ids")
    hi = n if hi is None else min(hi, n)
    offsets = np.frombuffer(data, "<u8", blocks * planes + 1, _HEAD.size)
    base = _HEAD.size + offsets.nbytes
    out, view = [], memoryview(data)
    plain = zstandard.ZstdDecompressor().decompress
    for b in range(lo // block, -(-hi // block)):
        size = min(block, n - b * block)
        rows = [np.frombuffer(plain(view[base + int(offsets[b * planes + p]) : base + int(offsets[b * planes + p + 1])], size), np.uint8) for p in range(planes)]
        ids = np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").ravel()
        out.append(ids[max(lo - b * block, 0) : hi - b * block])
    return np.concatenate(out) if out else np.zeros(0, "<u4")


_STORE = "part int, chunk int, start_in_part long, n_ids long, doc_ids array<long>, doc_lengths array<long>, container binary"


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, kind: str = "word", end_id: int = END_ID, block: int = BLOCK, chunk: int = CHUNK, memory: int = 200_000) -> None:
    """Encode every whole text and write the store to path, in ascending doc_id order (null ids first).

    Rows of one id are ordered by a hash of their text; equal rows also by where they were read, so that no single id
    or row fills a range on its own.
    """
    tokenizer = tokenizer or str(public_tokenizers.path(TOKENIZER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, kind, memory)
        part, chunks, start = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        doc_ids: list = []
        n = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [[part], [chunks], [start], [len(ids)], [doc_ids], [[len(x) for x in held]], [write_container(ids, block)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "chunk", "start_in_part", "n_ids", "doc_ids", "doc_lengths", "container"])

        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                ids, sizes = encoder.encode(batch.column(1).slice(lo, hi - lo).fill_null("").to_pylist())
                ends = np.cumsum(sizes)
                for i, doc_id in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    held.append(np.append(ids[ends[i] - sizes[i] : ends[i]], np.int32(end_id)))
                    doc_ids.append(doc_id)
                    n += len(held[-1])
                    if n >= chunk:
                        yield flush()
                        chunks, start, held, doc_ids, n = chunks + 1, start + n, [], [], 0
        if held:
            yield flush()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__h"), F.monotonically_increasing_id().alias("__i"))
    ordered = keyed.repartitionByRange("doc_id", "__h", "__i").sortWithinPartitions("doc_id", "__h", "__i").select("doc_id", "text")
    ordered.mapInArrow(run, _STORE).write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if wanted."""
    store = spark.read.schema(_STORE).parquet(path)
    fields = "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = read_container(batch.column(4)[r].as_buffer())
                doc_ids, sizes = batch.column(2).slice(r, 1).flatten(), batch.column(3).slice(r, 1).flatten().to_numpy()
                ends = np.cumsum(sizes)
                own = [ids[e - s : e] for e, s in zip(ends, sizes, strict=True)]
                out = [pa.array(np.full(len(sizes), batch.column(0)[r].as_py()), pa.int32()), doc_ids, pa.array(batch.column(1)[r].as_py() + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(np.ascontiguousarray(x)) for x in own], pa.int64())]
                names = ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    found = store.select("part", "start_in_part", "doc_ids", "doc_lengths", "container").mapInArrow(run, fields)
    # One row for each file written: their running sum is the only thing that goes through one task.
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select(F.col("part").alias("__p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return found.join(starts, F.col("part") == F.col("__p")).withColumn("start", F.col("__start") + F.col("start_in_part")).select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the store to the shared folder and read its documents back.

    Null text is empty and has just the end id; empty tables give an empty result; repeated rows are documents of
    their own; other columns are ignored.
    """
    path = new_path(docs.sparkSession, "token-store")
    write_store(docs, path, **options)
    return read_documents(docs.sparkSession, path)
