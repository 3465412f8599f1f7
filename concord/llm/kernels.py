"""Small numpy helpers that run inside Spark tasks on Arrow batches of texts.

Every function takes one bounded batch. Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2^64
BASE_INV = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)  # x20 and x09-x0D part words
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)  # A-Z only
LOWER[65:91] += 32
BYTE_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i in 0..n."""
    if len(_powers.get("up", ())) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (a murmur-style finaliser)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of codes[i] * BASE^i, one longer than codes."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(len(codes))[0][: len(codes)], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each codes[start:end] that does not depend on the place."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def window_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each codes[i:i+n]."""
    if len(codes) < n:
        return np.zeros(0, U64)
    prefix = prefix_hash(codes)
    down = powers(len(prefix))[1]
    return mix((prefix[n:] - prefix[: len(codes) - n + 1]) * down[: len(codes) - n + 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, joined, and each text's offset."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


PIECE = 1 << 20  # bytes that are hashed at once: memory does not grow with a text by more than its words


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hash of the codes of data[start:end] for ascending spans that do not overlap, piece by piece."""
    out = np.empty(len(start), U64)
    k = 0
    while k < len(start):
        last = max(k + 1, int(np.searchsorted(end, start[k] + PIECE, "right")))
        low = start[k]
        prefix = prefix_hash(BYTE_CODE[data[low : end[last - 1]]])
        out[k:last] = span_hash(prefix, start[k:last] - low, end[k:last] - low)
        k = last
    return out


class Words(NamedTuple):
    data: np.ndarray  # bytes
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # per document, the index of its first word; one more at the end
    hash: np.ndarray


def words(column: pa.Array, lower: bool = True) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of every text, with 64-bit hashes; `lower` lower-cases A-Z."""
    raw, at = text_bytes(column)
    data = LOWER[raw] if lower else raw
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge] = inside[edge]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, at)
    return Words(data, start, end, first, spans_hash(data, start, end))


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document's number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def doc_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values per document; rows of `values` follow the words."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
