"""Vectorised kernels over the UTF-8 bytes of a column: words, hashes of words, hashes of word shingles.

Words are runs of bytes outside a separator class, so all classes here are ASCII and multi-byte characters need no decoding.
Hashes are 64 bits: a polynomial over randomised byte values, mixed. They select; callers that promise exactness compare texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240607))
_ODD = lambda n: _RNG.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
BASE = int(_ODD(1)[0])
BASE_INVERSE = pow(BASE, -1, 2**64)
STEP = _ODD(64)

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """base**i and base**-i for i up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(20, int(n + 1).bit_length())
        made = []
        for base in (BASE, BASE_INVERSE):
            p = np.ones(size, np.uint64)
            k = 1
            while k < size:
                p[k : 2 * k] = p[:k] * np.uint64(pow(base, k, 2**64))
                k *= 2
            made.append(p)
        _POWERS[:] = made
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes, a longer row alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (n + 1 entries)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    begins = inside & (~before | first[:n])
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    stops = inside & (~after | first[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((BYTE_LOWER if lower else BYTE)[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i .. i + k - 1 for each i; over the whole batch, rows are the caller's to respect."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total = h[: len(h) - k + 1] * STEP[0]
    for j in range(1, k):
        total = total + h[j : len(h) - k + 1 + j] * STEP[j]
    return mix(total)


def filter_place(h: np.ndarray, bits: int) -> np.ndarray:
    """Place of a mixed hash in a bitmap of 2**bits places."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by the column."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = table.column(column).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        held = table.slice(last)
        if last:
            yield table.slice(0, last)
    if held is not None and len(held):
        yield held
