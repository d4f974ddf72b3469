"""Words of whole Arrow batches, hashed without a Python loop over words.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered. All positions of a
chunk come from one pass; a word's 64-bit hash is the difference of two prefix sums of a
polynomial in an odd base, times the inverse power of its start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = (1 << 19) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer with full avalanche over 64 bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(size, base, U64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, nulls as empty, and n+1 offsets."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about `limit` bytes; a longer text stands alone, whole."""
    raw, offsets = utf8(column)
    n, low = len(offsets) - 1, 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, n)
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word goes over the end of its text."""
    solid = ~SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[offsets < len(raw)]
    first[edge] = solid[edge]
    edge = offsets[(offsets > 0)] - 1
    last[edge] = solid[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and n+1 offsets into them for the texts."""
    if not len(raw):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    low = LOWER[raw]
    starts, ends = word_spans(low, offsets)
    size = 1 << max(19, int(len(raw)).bit_length())
    power, inverse = powers(size)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((low.astype(U64) + U64(1)) * power[: len(raw)], out=total[1:])
    hashed = mix((total[ends] - total[starts]) * inverse[starts])
    return hashed, np.searchsorted(starts, offsets)


GRAM = [U64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k-1 positions are missing."""
    if len(words) < k:
        return np.zeros(0, U64)
    n = len(words) - k + 1
    out = words[:n] * GRAM[0]
    for i in range(1, k):
        out = (out ^ (out >> U64(32))) + words[i : i + n] * GRAM[i % len(GRAM)]
    return mix(out)
