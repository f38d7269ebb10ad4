"""Word tokens and 64-bit hashes over Arrow text columns, vectorised with numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D (UTF-8 bytes
above 0x7F never match those, so byte runs equal code-point runs). A null text
has no words. Everything works on one Arrow batch; ``slices`` keeps a batch
small enough that the arrays of one slice fit a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 6 << 20
LONG_WORD = 512  # bytes; longer words are hashed one by one

#: Bytes between words: white space (the default), or all but digits, letters and bytes above 0x7F.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PUNCTUATION = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element (x: uint64, changed in place)."""
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text is about ``limit`` bytes; one longer row stays whole."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty; offsets has one entry more than rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Tokens:
    """Words of the rows of one text column: byte starts and lengths, row bounds, hashes."""

    def __init__(self, column: pa.Array, lower: bool, between: np.ndarray = SPACE):
        raw, off = text_bytes(column)
        self.data = _LOWER[raw] if lower else raw
        self.n_rows = len(off) - 1
        inner = ~between[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        if len(raw):
            first = inner.copy()
            first[1:] &= ~inner[:-1] | edge[1:-1]
            last = inner.copy()
            last[:-1] &= ~inner[1:] | edge[1:-1]
            self.starts = np.flatnonzero(first)
            self.ends = np.flatnonzero(last) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        #: words of row i are bounds[i]:bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word; equal bytes, equal hash."""
        size = self.ends - self.starts
        pad = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(pad) - 7,), np.dtype("<u8"), pad, strides=(1,))
        h = size.astype(np.uint64) * _GOLD
        short = size <= LONG_WORD
        todo = np.flatnonzero(short)
        k = 0
        while len(todo):
            h[todo] = mix(h[todo] ^ (lanes[self.starts[todo] + k] & _MASK[np.minimum(size[todo] - k, 8)]))
            k += 8
            todo = todo[size[todo] > k]
        for i in np.flatnonzero(~short):
            h[i] = xxhash.xxh64_intdigest(self.word(i))
        return h


def windows(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words that stays within one row: (index of the first word, hash)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        acc = mix(acc * _GOLD + h[k:k + n])
    count = np.diff(bounds)
    left = np.repeat(bounds[1:], count)[:n] - np.arange(n)
    at = np.flatnonzero(left >= width)
    return at, acc[at]


def rolling(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``windows`` in a time that does not grow with ``width``: binary doubling of run hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.full(len(h), np.uint64(width), np.uint64)
    run, size, done = h.copy(), 1, 0  # run[i] covers size words from i
    while True:
        if width & size:
            m = len(h) - done - size + 1
            acc[:m] = mix(acc[:m] * _GOLD + run[done:done + m])
            done += size
        if done == width:
            break
        m = len(run) - size
        run = mix(run[:m] * _GOLD + run[size:size + m])
        size *= 2
    count = np.diff(bounds)
    left = np.repeat(bounds[1:], count)[:n] - np.arange(n)
    at = np.flatnonzero(left >= width)
    return at, acc[:n][at]
