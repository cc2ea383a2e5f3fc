"""Words and word shingles of Arrow string batches, as vectors over their UTF-8 bytes.

A word is a longest run of bytes outside ``\\x20 \\x09-\\x0D``, with A-Z lower-cased. These bytes are all
ASCII, so working on bytes and on characters gives the same words. Null counts as the empty text.
Nothing here looks at Spark; the operators call it inside ``mapInArrow`` tasks.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are taken at once; bounds the temporary vectors of a task (about 40 bytes a byte of text).
SLICE_BYTES = 1 << 20

_SEED = np.random.Generator(np.random.PCG64(20240229))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random number for each byte, after lower-casing.
_BYTE = _SEED.integers(0, 1 << 64, 256, dtype=U64)[_LOWER]
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_PLACE = _SEED.integers(0, 1 << 64, 64, dtype=U64) | U64(1)


def release() -> None:
    """Gives memory that a task has freed back to the system: its worker process lives on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidy(task: Callable) -> Callable:
    """A function of a task's batches that leaves no freed memory behind when they are done."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the n + 1 offsets of its texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, a longer text by itself; they cover all rows."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it (n + 1 numbers)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, lower-cased."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    # Made anew for each slice: a table kept here would travel with every task function.
    up, down = _powers(_P, len(data) + 1), _powers(_P_INVERSE, len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and for each text the number of words before it."""
    starts, ends, counts = word_spans(data, offsets)
    return span_hashes(data, starts, ends), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of k words, and for each text the number of shingles before it.

    A text of 1 to k - 1 words has one shingle, all its words; a text without words has none.
    """
    n = np.diff(counts)
    made = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(int(bounds[-1]), dtype=U64)
    if len(words) >= k:
        every = words[: len(words) - k + 1] * _PLACE[0]
        for j in range(1, k):
            every += words[j : len(words) - k + 1 + j] * _PLACE[j]
        long = n >= k
        first = np.repeat(counts[:-1][long] - bounds[:-1][long], made[long])
        at = np.flatnonzero(np.repeat(long, made))
        out[at] = mix(every[first + at])
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = words[counts[i] : counts[i + 1]]
        out[bounds[i]] = mix(np.array([(own * _PLACE[: len(own)]).sum(dtype=U64) + U64(len(own))]))[0]
    return out, bounds


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text, in order, its distinct shingle hashes, ascending."""
    data, offsets = as_bytes(column)
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        hashes, bounds = shingle_hashes(*word_hashes(part, offsets[i : j + 1] - offsets[i]), k)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(hashes[a:b])
