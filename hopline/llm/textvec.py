"""Vectorised text primitives: whole Arrow string columns as flat byte arrays.

Every function works on one *chunk*: some whole documents whose bytes lie one after the other.
Chunks hold about ``CHUNK_BYTES``; one longer document makes a chunk of its own. Memory is then
bounded by the chunk and the longest single document, never by the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: What operators keep in a worker from task to task; another operator's task there drops it.
KEPT: list[dict] = []

#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse), kept for the next chunk."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 5 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def flatten(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty string."""
    return flatten_binary(pc.fill_null(column, ""))


def flatten_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut or joined so that each holds about ``limit`` bytes of ``column``."""
    for d in KEPT:
        d.clear()
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit - held, "right")))
            kept.append(batch.slice(at, to - at))
            held += int(ends[to - 1] - before)
            at = to
            if held >= limit or at < batch.num_rows:
                yield joined(kept)
                kept, held = [], 0
    if kept:
        yield joined(kept)
    kept = []
    _powers.clear()
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task does not hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, pointer): byte ranges of all words; document d has words pointer[d]:pointer[d + 1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separators[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | fresh[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Prefix:
    """Hashes of any byte ranges of one chunk, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", len(data)), out=self.sums[1:])
        self.inverse = _power("down", len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


class Words:
    """The words of a chunk's documents, each followed by one space, and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.pointer = words(data, offsets)
        lengths = ends - starts + 1
        self.starts = np.cumsum(lengths) - lengths
        self.ends = self.starts + lengths - 1
        self.data = np.full(int(lengths.sum()), 32, np.uint8)
        letters = np.ones(len(self.data), bool)
        letters[self.ends] = False
        self.data[letters] = data[~SPACES[data]]
        self.counts = np.diff(self.pointer)

    @cached_property
    def hash(self) -> Prefix:
        return Prefix(self.data)

    def runs(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from each word of ``at``."""
        return self.hash(self.starts[at], self.ends[at + n - 1])

    def windows(self, n: int) -> np.ndarray:
        """First words of all windows of n words."""
        last = np.repeat(self.pointer[1:], self.counts)
        return np.flatnonzero(np.arange(len(self.starts)) + n <= last)

    def prints(self) -> np.ndarray:
        """64 bits of each document's words, to tell rows with one doc_id apart."""
        out = np.zeros(len(self.counts), np.uint64)
        full = np.flatnonzero(self.counts)
        out[full] = self.hash(self.starts[self.pointer[full]], self.ends[self.pointer[full + 1] - 1])
        return out.view(np.int64)

    def text(self, d: int) -> memoryview:
        a, b = self.pointer[d], self.pointer[d + 1]
        return memoryview(self.data[self.starts[a] : self.ends[b - 1]]) if b > a else memoryview(b"")


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The byte ranges, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return data[np.arange(total, dtype=np.int64) + shift]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each i: whether the lengths[i] bytes from a[i] equal those from b[i]."""
    out = np.ones(len(a), bool)
    step = max(1, int((8 << 20) // max(1, int(lengths.max(initial=1)))))
    for i in range(0, len(a), step):
        n = lengths[i : i + step]
        unlike = gather(data, a[i : i + step], n) != gather(data, b[i : i + step], n)
        if unlike.any():
            owner = np.repeat(np.arange(len(n)), n)
            out[i + owner[unlike]] = False
    return out


def groups(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, with the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))
