"""Hash entries of documents, packed by the batch for a shuffle.

An entry is (document, position, hash). Those of a batch that go to one bucket travel as
one binary row: the documents' keys and counts, then the hashes (4 or 8 bytes each), then
the positions as differences of a byte or more. This takes a fifth of the bytes of a row
per entry, and numpy works on a bucket of entries at once. Buckets are dealt by hash, so
all entries with equal hashes meet; their number follows the input. What a batch can
judge by itself goes around the buckets (``settled``).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bytewords import U, mix

ROWS = "bucket int, blob binary"
HITS = "k1 long, k2 long, at binary"


def with_keys(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(doc_id, text, k1, k2, and more columns): 128 bits that name the row; equal rows share them."""
    own, text = F.col(id_col), F.col(text_col).cast("string")
    k1 = F.xxhash64(F.lit(1), own.cast("string"), F.lit(2), text)
    k2 = F.xxhash64(F.lit("k"), text, F.lit(3), own.cast("string"))
    return docs.select(own.alias("doc_id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"), *more)


def buckets_for(docs: DataFrame, text_col: str, entries_per_byte: float, entries_per_bucket: int = 4_000_000) -> int:
    """How many buckets keep each near the given number of entries; a pass over the texts' lengths."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(8, math.ceil(total * entries_per_byte / entries_per_bucket))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def pack(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray | None, h: np.ndarray, b: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    """Entries in order of (doc, at) as (bucket, blob). ``keys``: numbers of each document,
    that go with its entries; ``at`` None: no positions; ``width``: 4, 5 or 8 bytes of hash."""
    if not len(h):
        return
    order = np.argsort(b.astype(np.uint16) if b.max() < 1 << 16 else b, kind="stable")
    b, doc, h = b[order], doc[order], h[order]
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(b) != 0)]
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(b) != 0]), len(b)]
    runs = np.flatnonzero(new)
    counts = np.diff(np.r_[runs, len(b)]).astype("<u4")
    run_at = np.searchsorted(runs, cuts)
    parts = [(h.astype("<u8") if width == 8 else h.astype("<u4"), cuts)]
    if width == 5:
        parts.append(((h >> U(32)).astype(np.uint8), cuts))
    if at is not None:
        at = at[order]
        gap = at.copy()
        gap[1:] -= at[:-1]
        gap[new] = at[new]
        ends = np.cumsum(gap // 255 + 1)
        deltas = np.full(int(ends[-1]), 255, np.uint8)
        deltas[ends - 1] = gap % 255
        parts.append((deltas, np.r_[0, ends][cuts]))
    own = [k[doc[runs]].astype("<i8") for k in keys]
    for i in range(len(cuts) - 1):
        r = slice(run_at[i], run_at[i + 1])
        yield int(b[cuts[i]]), b"".join((struct.pack("<I", r.stop - r.start), *(k[r].tobytes() for k in own), counts[r].tobytes(), *(x[c[i] : c[i + 1]].tobytes() for x, c in parts)))


def unpack(blobs: list[bytes], n_keys: int, width: int, placed: bool = True) -> tuple[list[np.ndarray], np.ndarray, np.ndarray | None, np.ndarray]:
    """The keys of each run, and run, position and hash (its low bytes) of each entry."""
    keys, counts, hashes, at = [[] for _ in range(n_keys)], [], [], []
    for blob in blobs:
        n = struct.unpack_from("<I", blob)[0]
        for j in range(n_keys):
            keys[j].append(np.frombuffer(blob, "<i8", n, 4 + 8 * n * j))
        base = 4 + 8 * n * n_keys
        c = np.frombuffer(blob, "<u4", n, base)
        m, base = int(c.sum()), base + 4 * n
        h = np.frombuffer(blob, "<u8" if width == 8 else "<u4", m, base)
        if width == 5:
            h = np.frombuffer(blob, np.uint8, m, base + 4 * m).astype(np.uint64) << U(32) | h
        hashes.append(h)
        if placed:
            deltas = np.frombuffer(blob, np.uint8, -1, base + width * m)
            total = np.cumsum(deltas, dtype=np.int64)[deltas < 255]
            first = np.cumsum(c) - c
            at.append((total - np.repeat(np.where(first > 0, total[first - 1], 0), c)).astype(np.int32))
        counts.append(c)
    counts_ = np.concatenate(counts)
    return [np.concatenate(k) for k in keys], np.repeat(np.arange(len(counts_), dtype=np.int32), counts_), np.concatenate(at) if placed else None, np.concatenate(hashes)


def regroup(k1: np.ndarray, buckets: int) -> np.ndarray:
    """Where what is found out about a document meets again."""
    return bucket_of(mix(k1.view(np.uint64)), buckets)


def blob_table(found: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([b for b, _ in found], pa.int32()), "blob": pa.array([x for _, x in found], pa.binary())})


def by_document(keys: list[np.ndarray], run: np.ndarray, value: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The keys of each document (named by the first two) and its sorted values."""
    order = np.lexsort((value, keys[1][run], keys[0][run]))
    run, value = run[order], value[order]
    a, b = keys[0][run], keys[1][run]
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(run) else np.zeros(0, np.int64)
    return [k[run[cut]] for k in keys], np.split(value, cut[1:]) if len(cut) else []


def settled(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray, known: np.ndarray, reach: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Positions that a batch knows to be hits, as rows that ``hits`` passes on unjudged. Of
    consecutive ones both ends and each ``reach``-th stay: with so many words before or after
    each they cover the same."""
    at_known = np.flatnonzero(known)
    if not len(at_known):
        return
    d, p = doc[at_known], at[at_known]
    new = np.r_[True, (np.diff(d) != 0) | (np.diff(p) != 1)]
    start = np.flatnonzero(new)
    offset = np.arange(len(p)) - np.repeat(start, np.diff(np.r_[start, len(p)]))
    keep = (offset % reach == 0) | np.r_[new[1:], True]
    d, p = d[keep], p[keep]
    for b, blob in pack(keys, d, None, p.astype(np.uint64), regroup(keys[0], buckets)[d], 4):
        yield -1 - b, blob


def first_of(group: np.ndarray, n: int, among: np.ndarray | None = None) -> np.ndarray:
    """For each entry, whether it is the first of its group (of those ``among`` it)."""
    own = np.arange(len(group)) if among is None else np.flatnonzero(among)
    first = np.full(n, -1, np.int64)
    first[group[own[::-1]]] = own[::-1]
    out = np.zeros(len(group), bool)
    out[first[first >= 0]] = True
    return out


def hits(entries: DataFrame, width: int, buckets: int, judge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(k1, k2, at) for each document: positions of the entries that ``judge(at, hash)``
    picks among all entries of a bucket, or that came as ``settled``, as little-endian 32-bit
    integers."""

    def pick(key: tuple, table: pa.Table) -> pa.Table:
        if (own := key[0].as_py()) < 0:
            return pa.table({"bucket": pa.array([-1 - own] * table.num_rows, pa.int32()), "blob": table.column("blob")})
        keys, owner, at, h = unpack(table.column("blob").to_pylist(), 2, width)
        picked = np.flatnonzero(judge(at, h))
        to = regroup(keys[0], buckets)[owner[picked]]
        return blob_table(list(pack(keys, owner[picked], None, at[picked].astype(np.uint64), to, 4)))

    def gather(table: pa.Table) -> pa.Table:
        keys, owner, _, at = unpack(table.column("blob").to_pylist(), 2, 4, False)
        (k1, k2), cells = by_document(keys, owner, at)
        return pa.table({"k1": k1, "k2": k2, "at": pa.array([c.tobytes() for c in cells], pa.binary())})

    return entries.groupBy("bucket").applyInArrow(pick, ROWS).groupBy("bucket").applyInArrow(gather, HITS)


def grouped(h: np.ndarray) -> tuple[np.ndarray, int]:
    """For each entry, the number of its hash among the distinct ones, and how many those are."""
    if not len(h):
        return np.zeros(0, np.int32), 0
    if h.dtype.itemsize > 4:
        order = np.argsort(h, kind="stable").astype(np.int32)
        s = h[order]
        new = s[1:] != s[:-1]
    else:  # hash and entry sort as one number
        s = h.astype(np.uint64) << U(32)
        s |= np.arange(len(h), dtype=np.uint64)
        s.sort()
        order = (s & U(0xFFFFFFFF)).astype(np.int32)
        s >>= U(32)
        new = s[1:] != s[:-1]
    del s
    group = np.zeros(len(h), np.int32)
    group[order[1:]] = np.cumsum(new, dtype=np.int32)
    return group, int(group[order[-1]]) + 1
