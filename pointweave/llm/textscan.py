"""Vectorised scanning of many UTF-8 texts at once: word bounds, hashes of words, windows and lines.

A batch is one byte buffer with offsets, as Arrow holds it. All per-byte work is numpy over the buffer; no Python loop
runs over words. Hashes go through the buffer in pieces of a fixed size, so a very long text needs a few bytes for each
of its bytes and words, and tables don't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at once.
HASHED = 1 << 16


def _power_table(base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(HASHED, base)]))


_POWERS, _INVERSE = _power_table(_BASE), _power_table(_INV)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array | pa.ChunkedArray, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about most_bytes of text each (a longer text alone), so that memory follows bytes, not rows."""
    lengths = np.asarray(pc.binary_length(column).fill_null(0))
    ends = np.cumsum(lengths.astype(np.int64))
    lo, n = 0, len(lengths)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield lo, hi
        lo = hi


class Scan:
    """Words of a batch of texts, between bytes for which `space` is true. Null texts are empty.

    data: bytes; at: each text's start, and the end of the last; starts, ends: each word's byte range;
    first: each text's first word, and the number of all words.
    """

    def __init__(self, column: pa.Array, space: np.ndarray = _SPACE):
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        bufs = column.buffers()
        self.at = np.frombuffer(bufs[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1].copy() if len(column) else np.zeros(1, np.int64)
        lo, hi = int(self.at[0]), int(self.at[-1])
        self.data = np.frombuffer(bufs[2], dtype=np.uint8)[lo:hi] if bufs[2] is not None else np.zeros(0, np.uint8)
        self.at -= lo
        self.n = len(column)
        self.word = word = ~space[self.data]
        kind = np.int32 if len(word) < 1 << 31 else np.int64
        cut = self.at[(self.at > 0) & (self.at < len(self.data))]
        edge = word.copy()
        edge[1:] &= ~word[:-1]
        edge[cut] |= word[cut]
        self.starts = np.flatnonzero(edge).astype(kind)
        edge[:] = word
        edge[:-1] &= ~word[1:]
        edge[cut - 1] |= word[cut - 1]
        self.ends = (np.flatnonzero(edge) + 1).astype(kind)
        self.first = np.searchsorted(self.starts, self.at)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def per_text(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums of a per-byte count for each text."""
        out = np.zeros(self.n, np.int64)
        some = np.flatnonzero(np.diff(self.at))
        if len(some):
            out[some] = np.add.reduceat(per_byte, self.at[some], dtype=np.int64)
        return out

    def hash_ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range, the same wherever the bytes stand. Ranges are in order and don't overlap."""
        out = np.zeros(len(lo), np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(self.data), HASHED):
                end = min(at + HASHED, len(self.data))
                a, b = int(np.searchsorted(hi, at, "right")), int(np.searchsorted(lo, end, "left"))
                if a >= b:
                    continue
                h = np.zeros(end - at + 1, np.uint64)
                np.cumsum((self.data[at:end].astype(np.uint64) + np.uint64(1)) * _POWERS[: end - at], out=h[1:])
                left, right = np.maximum(lo[a:b], at) - at, np.minimum(hi[a:b], end) - at
                part = (h[right] - h[left]) * _INVERSE[left]
                if lo[a] < at:  # its beginning is in a piece before this one
                    part[0] *= np.uint64(pow(int(_BASE), at - int(lo[a]), 1 << 64))
                out[a:b] += part
            return mix64(out + (hi - lo).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        if not hasattr(self, "_words"):
            self._words = self.hash_ranges(self.starts, self.ends)
        return self._words

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of k words inside a text: first word, text, hash."""
        w = self.word_hashes()
        m = len(w) - k + 1
        if m <= 0:
            e = np.zeros(0, np.int32)
            return e, e, np.zeros(0, np.uint64)
        text = np.repeat(np.arange(self.n, dtype=np.int32), self.n_words)
        inside = np.flatnonzero(text[:m] == text[k - 1 :])
        with np.errstate(over="ignore"):
            h = np.zeros(m, np.uint64)
            for j in range(k):
                h *= np.uint64(0xD6E8FEB86659FD93)
                h += w[j : j + m]
            return inside, text[inside], mix64(h[inside])


def repeated(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where the same (text, hash) stands twice or more."""
    with np.errstate(over="ignore"):
        key = mix64(h + mix64(text.astype(np.uint64) + np.uint64(0x51ED27)))
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    del s
    if not len(twice):
        return np.zeros(len(key), bool)
    i = np.searchsorted(twice, key)
    i[i == len(twice)] = 0
    return twice[i] == key
