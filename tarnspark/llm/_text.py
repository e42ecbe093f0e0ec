"""Vectorised hashing of words, shingles and byte ranges.

Texts are handled as one UTF-8 buffer with offsets.  A range hash is a
difference of prefix sums of ``TABLE[byte] * B**position`` modulo 2**64, scaled
back by the inverse power, so that equal byte ranges hash equally wherever they
stand, and is then mixed.  Nothing here depends on the process or the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:  # only the GNU C library has malloc_trim
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _LIBC = None

#: Bytes of text that are hashed at once; a longer text is hashed alone.
SLICE = 1 << 18
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


class RangeHash:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_TABLE[data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few, so that what is made of a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def trim() -> None:
    """Give free memory back to the system; a worker waits for its next task after this."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and the index of each row's first word (one more at the end).

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  ``at`` starts at 0.
    """
    n = len(data)
    word = ~_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice, A-Z in lower case, and each row's first index."""
    starts, ends, first = words(data, at)
    hashed = RangeHash(_LOWER[data] if lower else data)
    return hashed(starts, ends), first


def _combine(parts: list[np.ndarray], length: int) -> np.ndarray:
    total = np.full(len(parts[0]), (length * 0xA0761D6478BD642F) & (2**64 - 1), U)
    for k, part in enumerate(parts):
        total += mix(part + U(((k + 1) * 0xE7037ED1A0B428DB) & (2**64 - 1)))
    return mix(total)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of a slice its sorted distinct ``k``-word shingles.

    A row with fewer words has the whole sequence as one; one without words has none.
    """
    hashes, first = word_hashes(data, at)
    n = len(hashes)
    all_of = _combine([hashes[i : n - k + 1 + i] for i in range(k)], k) if n >= k else np.zeros(0, U)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(all_of[a : b - k + 1]))
        elif b > a:
            out.append(_combine([hashes[i : i + 1] for i in range(a, b)], b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def row_shingle_sets(column: pa.Array | pa.ChunkedArray, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each row of a string column, whole texts, in order."""
    data, at = buffers(column)
    for i, j in slices(at):
        yield from shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k)
