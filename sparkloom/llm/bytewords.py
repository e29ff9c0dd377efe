"""Words of Arrow string columns as numpy arrays, a batch of rows at a time.

Words are maximal runs of bytes of a class. As every byte of a multi-byte UTF-8
character is >= 0x80, a class that treats all those bytes alike is the same as the
class of code points that the operators' contracts state. All hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
U = np.uint64


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    lut = np.ones(256, dtype=bool)
    for low, high in excluded:
        lut[low : high + 1] = False
    return lut


#: [^\x20\x09-\x0D]+
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * M2
    h = (h ^ (h >> U(27))) * M3
    return h ^ (h >> U(31))


@dataclass
class Words:
    """Words of a run of documents; word ``i`` is ``data[starts[i]:ends[i]]``, those of
    document ``d`` are ``first[d]:first[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes, eight bytes a pass."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.uint64)
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        at = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        length = self.ends - self.starts
        keep = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)
        h = mix((at[self.starts] & keep[np.minimum(length, 8)]) + M1 * length.astype(np.uint64))
        more, done = np.flatnonzero(length > 8), 8
        while len(more):
            left = length[more] - done
            block = at[self.starts[more] + done] & keep[np.minimum(left, 8)]
            h[more] = mix(h[more] * M1 + block)
            more, done = more[left > 8], done + 8
        return h

    def texts(self, which: np.ndarray | None = None) -> list[str]:
        s, e = (self.starts, self.ends) if which is None else (self.starts[which], self.ends[which])
        raw = self.data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist())]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    return offsets - low, data


def find_words(offsets: np.ndarray, data: np.ndarray, lut: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    inside = lut[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False  # a document's first byte
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False  # a document's last byte
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, BASE_INV)):
            p = np.full(n + n // 4, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of words) where a window of ``size`` words of one document starts, and
    a hash of each window's word sequence."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    powers, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers, out=total[1:])
    w = mix((total[size:] - total[:-size]) * inverse[: n - size + 1])
    ok = np.ones(n - size + 1, bool)
    inner = first[1:-1]
    crossing = inner[:, None] - np.arange(1, size)[None, :]  # windows that start before a border and end after it
    crossing = crossing[(crossing >= 0) & (crossing < len(ok))]
    ok[crossing] = False
    at = np.flatnonzero(ok)
    return at, w[at]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about ``max_bytes``; a longer row is a part of its own."""
    offsets, _ = text_buffer(batch.column(column))
    low, n = 0, batch.num_rows
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + max_bytes, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and count, in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
