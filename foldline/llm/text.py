"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``.  Words are hashed
straight from the UTF-8 buffer with a polynomial modulo 2**64 computed by prefix
sums, so no Python object exists per word.  Every hash is a pure function of the
word sequence: it does not depend on batch borders, partitions or the process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT, _MULT_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_GRAM, _GRAM_INV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
CHUNK_BYTES = 2 << 20
#: For stages whose workers run beside an executor heap that earlier stages have filled.
LEAN_BYTES = CHUNK_BYTES // 4

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if n <= CHUNK_BYTES * 2:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


class Words:
    """The words of a string column: hash, byte start and end of each, and ``ptr``, the
    index of each row's first word (one more entry than rows)."""

    def __init__(self, col: pa.Array, lower: bool = False):
        data, off = string_buffers(col)
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, off
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = off[(off > 0) & (off < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, off)
        self._hash = self._odd = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n = len(self.data)
            total = np.zeros(n + 1, U)
            np.cumsum((self.data.astype(U) + U(1)) * powers(_MULT_INV, n), out=total[1:])
            value = (total[self.end] - total[self.start]) * powers(_MULT, n)[self.end - 1] if n else total[:0]
            self._hash = mix(value + (self.end - self.start).astype(U) * U(0xA24BAED4963EE407))
        return self._hash

    def row_of(self) -> np.ndarray:
        """The row that each word belongs to."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b - 1 of one row, joined by one space each: the bytes as they stand where
        they are so already."""
        if self._odd is None:
            apart = np.zeros(len(self.start), bool)
            apart[1:] = (self.start[1:] - self.end[:-1] != 1) | (self.data[np.minimum(self.end[:-1], len(self.data) - 1)] != 0x20)
            self._odd = np.append(0, np.cumsum(apart))  # odd gaps before the words
        if a >= b:
            return b""
        if self._odd[b] == self._odd[a + 1]:
            return self.data[self.start[a] : self.end[b - 1]].tobytes()
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))

    def text(self, row: int) -> list[bytes]:
        a, b = self.ptr[row], self.ptr[row + 1]
        return [self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True)]


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (rows are not looked at)."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    total = np.zeros(n + 1, U)
    np.cumsum((h ^ U(salt)) * powers(_GRAM_INV, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_GRAM, n)[k - 1 :])


def sliding(values: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each w consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= w:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(values) - w + 1], out[w - have :]) if have < w else out


def chunked(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        if pa.types.is_string(col.type):
            off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        else:
            off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
            b = min(b, batch.num_rows)
            yield batch.slice(a, b - a)
            a = b


def release() -> None:
    """Give the system back what this process has freed; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; a worker that waits for its next task then holds little
    of the last one's."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row's list."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
