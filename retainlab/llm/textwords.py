"""Vectorised word, hash and n-gram helpers over Arrow string batches.

All operators on whole texts share these: a batch of texts is one byte buffer
plus offsets, and words, hashes and n-grams are NumPy passes over the buffer.
Null texts count as empty.  Slices bound the memory of a pass; a single text
longer than a slice is one slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

U = np.uint64


def byte_table(inside: Callable[[int], bool]) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    return np.array([inside(b) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``: UTF-8 continuation and lead bytes are never white space here
SPACE_SPLIT = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased text
ALNUM_SPLIT = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95  # odd, so invertible modulo 2^64
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        up, down = np.full(n, U(_BASE)), np.full(n, U(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = U(1)
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into row ranges of about ``limit`` bytes: (first, last, bytes, offsets)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(off, off[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[off[first]:off[last]], off[first:last + 1] - off[first]
        first = last


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray,
          fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends (byte positions in ``buf``) and each text's range of words.

    ``inside`` is looked up on the folded byte; a word never crosses texts.
    """
    m = inside[fold[buf]] if len(buf) else np.zeros(0, bool)
    st, en = m.copy(), m.copy()
    st[1:] &= ~m[:-1]
    en[:-1] &= ~m[1:]
    full = off[:-1] < off[1:]
    b, e = off[:-1][full], off[1:][full] - 1
    st[b], en[e] = m[b], m[e]
    s, e = np.flatnonzero(st), np.flatnonzero(en) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each byte range: polynomial over the folded bytes, length, then mixed."""
    up, down = _powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[fold[buf]] * up[:len(buf)], out=c[1:])
    return mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64) * U(0x632BE59BD9B4E019))


_STEP = U(0xA0761D6478BD642F)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``n`` consecutive word hashes from each position that has them in ``h``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = np.full(len(h) - n + 1, U(n))
    for j in range(n):
        g = g * _STEP + h[j:len(h) - n + 1 + j]
    return mix(g)


def window_starts(woff: np.ndarray, n: int) -> np.ndarray:
    """Positions that begin ``n`` words of one text."""
    end = np.repeat(woff[1:], np.diff(woff))
    return np.flatnonzero(np.arange(len(end)) + n <= end)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
