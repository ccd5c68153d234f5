"""Vectorised 64-bit word and shingle hashes over Arrow text batches.

Words are runs of bytes outside space and U+0009..U+000D, with A-Z folded to lower case. A batch is cut into slices of
a few megabytes so that memory stays bounded whatever the number of rows; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[k] = table
    return _powers


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first word of each document) for the bytes ``data``; ``bounds`` are the documents' ends, from 0.

    A word never spans two documents.
    """
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, np.zeros(len(bounds), np.int64)
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    begins[edges] = word[edges]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = word
    ends[1:-1] &= ~word[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, start, end, np.searchsorted(start, bounds)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; fewer words than k make one shingle of all of them."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    odd = _multipliers(k)
    out = np.full(n - width + 1, np.uint64(width * 0x632BE59BD9B4E019 & (1 << 64) - 1), np.uint64)
    for j in range(width):
        out += hashes[j : n - width + 1 + j] * odd[j]
    return mix(out)


@lru_cache
def _multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(7919).integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, document bounds) of consecutive rows of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    texts = texts.fill_null("") if texts.null_count else texts
    _, at, raw = texts.buffers()
    ends = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def document_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text."""
    for row, data, bounds in slices(texts):
        hashes, _, _, first = words_of(data, bounds)
        for i in range(len(bounds) - 1):
            yield row + i, hashes[first[i] : first[i + 1]]


def document_shingles(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for row, hashes in document_words(texts):
        yield row, np.unique(shingles(hashes, k))
