"""Vectorised words of Arrow text batches: spans, 64-bit hashes, word windows.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 multi-byte
characters hold none of these bytes, so bytes and code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Text that a task works on at once; its arrays take some tens of times as much, in each Python worker.
SLICE_BYTES = 1 << 19
#: Bytes hashed at once; the table of powers is about as long.
SEGMENT_BYTES = 1 << 16

LONGS = T.ArrayType(T.LongType())

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array (nulls are empty) and each row's offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes, at least one row each; a batch of no rows gives one."""
    _, off = text_bytes(texts)
    lo, n = 0, len(texts)
    while lo < n or n == 0:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + budget, "right")) - 1))
        yield lo, hi
        if hi >= n:
            return
        lo = hi


class Words:
    """Words of a slice of rows.  ``offset[i]:offset[i + 1]`` are row i's words."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True):
        self.data, self.row = text_bytes(texts)
        if lower:
            self.data = _LOWER[self.data]
        size = len(self.data)
        word = ~_IS_WHITE[self.data]
        edge = np.zeros(size + 1, bool)
        edge[self.row] = True
        first, last = word.copy(), word.copy()
        if size:
            first[1:] &= ~word[:-1] | edge[1:size]
            last[:-1] &= ~word[1:] | edge[1:size]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offset = np.searchsorted(self.start, self.row)
        self.count = np.diff(self.offset)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        #: words from here to the end of the row, this one included
        self.left = self.offset[1:][self.doc] - np.arange(len(self.doc))
        if hashes:
            self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Polynomial hashes from prefix sums, in segments that end between words."""
        out = np.empty(len(self.start), np.uint64)
        lo, i = 0, 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.start, lo + SEGMENT_BYTES)))
            lo, hi = self.start[i], self.end[j - 1]
            seg = _VALUE[self.data[lo:hi]] * _power("up", hi - lo)[:hi - lo]
            total = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(seg, out=total[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = (total[e] - total[s]) * _power("down", hi - lo)[s]
            lo, i = hi, j
        return mix(out)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows, and which of them stay in one row."""
        size = max(0, len(self.hash) - n + 1)
        x = np.zeros(size, np.uint64)
        for k in range(n):
            x = x * _STEP + self.hash[k:k + size]
        return mix(x + np.uint64(n)), self.left[:size] >= n

    def kept_bytes(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the kept words of all rows, joined by one space, and each row's offsets."""
        s, e, doc = self.start[keep], self.end[keep], self.doc[keep]
        depth = np.zeros(len(self.data) + 1, np.int8)
        depth[s] += 1
        depth[e] -= 1
        inside = np.cumsum(depth[:-1], dtype=np.int8).astype(bool)
        gap = e[:-1][doc[:-1] == doc[1:]]  # a later word follows in the row, so this byte is white
        chosen = inside.copy()
        chosen[gap] = True
        out = np.where(inside, self.data, np.uint8(32))[chosen]
        return out, np.concatenate([[0], np.cumsum(chosen)])[self.row]


def join_windows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a window from the hashes of its two halves."""
    return mix(a * _STEP + b + np.uint64(0x51ED2701))


def longs(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed longs."""
    return values.view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def record(**fields: T.DataType) -> T.StructType:
    """Result type of a UDF (a type object: workers have no session to parse a string)."""
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
