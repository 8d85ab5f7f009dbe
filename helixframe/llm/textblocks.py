"""Vectorised word hashing over Arrow text columns, a bounded block of bytes at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; the arrays of a block take about sixty times as much.
BLOCK_BYTES = 1 << 20
_M1, _M2, _GOLD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on batches; at the end of a task, memory that its blocks took goes back to the system.

    Worker processes are kept for later tasks, and would else keep the most that any task of theirs has needed.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_M1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def random_table(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLD) + np.uint64(seed * 2 + 1))


def white_space() -> np.ndarray:
    """True at the bytes that end a word: space and 0x09 to 0x0D."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def non_letters() -> np.ndarray:
    """True at ASCII bytes that are not letters; bytes of other scripts count as letters."""
    t = np.ones(256, bool)
    t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1] = t[128:] = False
    return t


def slices(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``most`` bytes; a longer text is a run of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    group = np.cumsum(size) // most
    at = 0
    while at < len(size):
        end = int(np.searchsorted(group, group[at], "right"))
        yield batch.slice(at, end - at)
        at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text begins (one more entry ends the last). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


class WordHasher:
    """64-bit hashes of the words of a block of texts.

    ends: bytes that end words. lower: A-Z count as a-z. Two hashers of different seeds are independent.
    """

    def __init__(self, seed: int = 1, ends: np.ndarray | None = None, lower: bool = False):
        self.ends = white_space() if ends is None else ends
        self.table = random_table(seed, 256) | np.uint64(1)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.table[self.ends] = 0
        self.base = int(random_table(seed + 7919, 1)[0]) | 1
        self.power = np.ones(1, np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.power) < n:
            p = np.full(n, self.base, np.uint64)
            p[0] = 1
            self.power = np.multiply.accumulate(p)
        return self.power

    def spans(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word starts and ends, and the row of its text."""
        if not len(raw):
            z = np.zeros(0, np.int64)
            return z, z, z
        sep = self.ends[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        before = np.empty(len(raw), bool)
        before[0], before[1:] = True, sep[:-1]
        starts = np.flatnonzero(~sep & (before | edge[:-1]))
        after = np.empty(len(raw), bool)
        after[-1], after[:-1] = True, sep[1:]
        ends = np.flatnonzero(~sep & (after | edge[1:])) + 1
        return starts, ends, np.searchsorted(off, starts, "right") - 1

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        length = ends - starts
        span = np.diff(np.append(starts, len(raw)))
        place = np.arange(starts[0], len(raw)) - np.repeat(starts, span)
        value = self.table[raw[starts[0] :]]
        np.minimum(place, int(length.max()), out=place)
        value = value * self._powers(int(length.max()) + 1)[place]
        return mix(np.add.reduceat(value, starts - starts[0]) + length.astype(np.uint64) * np.uint64(_GOLD))


def grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of n words of one text: (hash, row, index of its first word). Order counts."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(_M1 | 1) + words[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(h[at]), doc[at], at
