"""Vectorised words and shingles of Arrow string columns, for use inside mapInArrow tasks.

Words are runs of bytes outside 0x20 and 0x09-0x0D, lower-cased over A-Z. A word's 64-bit hash is a table-driven
polynomial over its bytes, found for all words of a chunk by one cumulative sum; equal words have equal hashes in
every task. A null text is an empty one. Memory follows the chunk size, or the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
#: Odd multipliers of the words of a shingle, without linear relations between them.
_PLACE = mix(np.arange(64, dtype=U64) * U64(0xA0761D6478BD642F) + U64(1)) | U64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n (mod 2**64), kept between chunks."""
    got = _powers.get(int(base))
    if got is None or len(got) <= n:
        got = np.empty(max(n + 1, 1 << 16), dtype=U64)
        got[0] = 1
        got[1:] = base
        got = np.multiply.accumulate(got)
        if len(got) <= 4 * CHUNK_BYTES:
            _powers[int(base)] = got
    return got


@dataclass
class Chunk:
    """Some rows of a batch: their bytes and the words in them."""

    lo: int  # first row in the batch
    hi: int
    data: np.ndarray  # uint8, the texts as given
    offsets: np.ndarray  # byte offset of each text in data, one more than texts
    low: np.ndarray = None  # data, lower-cased
    starts: np.ndarray = None  # of words
    ends: np.ndarray = None
    words: np.ndarray = None  # number of the first word of each text, one more than texts
    hashes: np.ndarray = None

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words)

    def n_chars(self) -> np.ndarray:
        """Code points of each text."""
        lead = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return np.diff(lead[self.offsets])

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64) of a string column; null is empty."""
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def release() -> None:
    """Gives freed memory back to the system. Python workers outlive their tasks and would keep it beside the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def raw_chunks(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if not len(col):
        return
    data, offsets = string_parts(col)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    release()


def find_words(c: Chunk, lower: bool = True) -> Chunk:
    """Fills in the words of a chunk and their hashes."""
    c.low = _LOWER[c.data] if lower else c.data
    n = len(c.low)
    if not n:
        c.starts = c.ends = np.zeros(0, np.int64)
        c.hashes = np.zeros(0, U64)
        c.words = np.zeros(len(c.offsets), np.int64)
        return c
    word = ~_SPACE[c.low]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    edge = c.offsets[:-1][c.offsets[:-1] < n]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    after[edge[edge > 0] - 1] = False
    c.starts = np.flatnonzero(word & ~before)
    c.ends = np.flatnonzero(word & ~after) + 1
    c.words = np.searchsorted(c.starts, c.offsets)
    c.hashes = span_hashes(c, c.starts, c.ends)
    return c


def span_hashes(c: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the lower-cased bytes of each span; depends on the bytes alone."""
    n = len(c.low)
    if not hasattr(c, "_sums"):
        sums = np.empty(n + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(_TABLE[c.low] * _power(_INVERSE, n)[:n], out=sums[1:])
        c._sums = sums
    return mix((c._sums[ends] - c._sums[starts]) * _power(_BASE, n)[starts] + (ends - starts).astype(U64))


def chunks(col: pa.Array, size: int = CHUNK_BYTES, lower: bool = True) -> Iterator[Chunk]:
    """The rows of a column, a bounded number of bytes at a time, with their words."""
    for c in raw_chunks(col, size):
        yield find_words(c, lower)


def shingles(hashes: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order, and their offsets by text.

    A text of fewer than k words (but one at least) has its whole sequence as its one shingle.
    """
    n_words = np.diff(words)
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(int(offsets[-1]), dtype=U64)
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, dtype=U64)
        for j in range(k):
            rolled += hashes[j : len(hashes) - k + 1 + j] * _PLACE[j]
        full = np.flatnonzero(n_words >= k)
        c = counts[full]
        first = np.repeat(words[full] - np.concatenate(([0], np.cumsum(c)))[:-1], c)
        at = np.arange(int(c.sum()))
        into = np.repeat(offsets[full] - np.concatenate(([0], np.cumsum(c)))[:-1], c) + at
        out[into] = mix(rolled[first + at])
    for m in range(1, k):
        for i in np.flatnonzero(n_words == m):
            x = U64(m)
            for j in range(m):
                x = mix(np.array([x]))[0] + hashes[words[i] + j]
            out[offsets[i]] = mix(np.array([x ^ U64(0x5851F42D4C957F2D)]))[0]
    return out, offsets
