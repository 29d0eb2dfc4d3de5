"""Vectorised words and word hashes of whole Arrow batches of texts.

A word is a maximal run of bytes other than the ASCII space and ``\\t`` to
``\\r``.  Hashes are 64-bit, the same in every process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into word arrays at a time (a longer single text is taken alone).
SLICE_BYTES = 512 << 10
_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of some texts: byte spans in ``data``, owner text and hash of each word."""

    data: np.ndarray  # uint8: all texts, each followed by one newline
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1] - 1]
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    hash: np.ndarray  # uint64
    first: np.ndarray  # words of text i are first[i]:first[i + 1]
    spans: Callable[[np.ndarray, np.ndarray], np.ndarray]  # hash of each byte span


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, factor = 1, base
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(factor)
        done += step
        factor = factor * factor % (1 << 64)
    return out


_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(texts: list[bytes], lower: bool = False, positions: dict | None = None, separators: np.ndarray = _WHITE) -> Words:
    """Words of ``texts``; ``lower`` turns A-Z into a-z first (in ``data`` too).

    ``separators`` flags the byte values between words, the newline among them.
    """
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    white = separators[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(data) and not white[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]  # data ends with white space
    cache = positions if positions is not None else {}
    if cache.get("n", 0) < len(data):
        cache["n"] = len(data)
        cache["up"], cache["down"] = _powers(len(data), _BASE), _powers(len(data), _INVERSE)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * cache["up"][: len(data)], out=total[1:])

    def spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((total[b] - total[a]) * cache["down"][a] + (b - a).astype(np.uint64))

    first = np.searchsorted(start, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, offsets, start, end, owner, spans(start, end), first, spans)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` words (windows may cross texts: the caller leaves those out)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    factor = _BASE
    for i in range(k):
        value += hashes[i : i + n] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    return mix(value)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches with about ``SLICE_BYTES`` of text in ``column``, and the texts (null: empty).

    Only the texts of one part are Python objects at a time.
    """
    for batch in batches:
        data = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.cumsum(sizes)
        begin = done = 0
        while begin < len(sizes):
            stop = max(begin + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
            yield batch.slice(begin, stop - begin), [t or b"" for t in data.slice(begin, stop - begin).to_pylist()]
            begin, done = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()
