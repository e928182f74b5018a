"""Byte and word kernels over Arrow text columns, in numpy.

A *block* is a run of whole documents as one uint8 array and int64 offsets.
Blocks hold about ``BLOCK_BYTES`` (one longer document is a block of its own),
so temporaries stay a small multiple of that however large an Arrow batch is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
ALL = 0xFFFFFFFFFFFFFFFF
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, bytes, offsets) of each block."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(size, _P, np.uint64), np.full(size, _P_INVERSE, np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    return _powers(1 << max(20, int(size + 1).bit_length()))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S[i] = sum of (byte + 1) * base**j over j < i, modulo 2**64."""
    p, _ = powers(len(data))
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = powers(len(s))
    return mix((s[end] - s[start]) * q[start])


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word: ``[^\\x20\\x09-\\x0D]+``, or what ``space`` parts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    first[offsets[full]] = inside[offsets[full]]
    last[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased."""
    return span_hash(prefix_hash(LOWER[data]), start, end)


def shingles(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word of every run of ``n`` words.

    A document of 1 to n - 1 words has the one shingle of all its words.
    """
    m = len(hashes)
    if m == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.uint64(0xD6E8FEB86659FD93)
    out_h, out_d, out_i = [], [], []
    if m >= n:
        g = hashes[: m - n + 1]
        for j in range(1, n):
            g = mix(g * k + hashes[j : m - n + 1 + j])
        whole = doc[: m - n + 1] == doc[n - 1 :]
        at = np.flatnonzero(whole)
        out_h, out_d, out_i = [g[at]], [doc[at]], [at]
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[begin, m])
    short = np.flatnonzero(size < n)
    for b, s in zip(begin[short].tolist(), size[short].tolist()):
        g = hashes[b : b + 1]
        for j in range(1, s):
            g = mix(g * k + hashes[b + j : b + j + 1])
        out_h.append(mix(g + np.uint64(s)))
        out_d.append(doc[b : b + 1])
        out_i.append(np.array([b]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, d, i = np.concatenate(out_h), np.concatenate(out_d), np.concatenate(out_i)
    if len(short) and len(out_h) > len(short):
        order = np.argsort(i, kind="stable")
        h, d, i = h[order], d[order], i[order]
    return h, d, i
