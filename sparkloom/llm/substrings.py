"""Substring dedup: words covered by a window that occurs anywhere else are removed.

Fixed-block anchors. With windows of ``window`` words, any occurrence holds one whole
block of ``(window + 1) // 2`` words that starts at a multiple of that length. So those
non-overlapping blocks are indexed, and every rolling window of that length probes the
index (``anchors``). A hit elsewhere is extended: the full windows around it are compared
by a 64-bit hash of their words with all others that have hits (``repeats``); runs of
equal ones are the maximal exact repeats. A common passage costs rows in proportion to
its occurrences, never their pairs, and its windows go to many buckets. What occurs twice
in a batch of documents is judged there; one entry of it goes on as a witness for other
batches, so that a passage that a third of all documents hold sends one entry a batch to
its bucket, not one a document.

Windows count as equal by 64 bits of hash, blocks by 32 bits within a bucket; blocks only
say which windows are looked at.

Defined results. Null or empty text: no words; the kept text is empty. Texts shorter than
a window: nothing removed. Repeated rows are two occurrences: all their windows go. A
null id stays null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bytewords import SPACED, find_words, slices, spread, text_buffer, windows
from sparkloom.llm.routing import ROWS, bucket_of, buckets_for, first_of, grouped, hits, pack, settled, with_keys
from sparkloom.llm.shared import table

WORDS_PER_BYTE = 0.18


def _keys(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column("k1").to_numpy(zero_copy_only=False), batch.column("k2").to_numpy(zero_copy_only=False)]


def _blobs(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "blob"])


def anchors(docs: DataFrame, window: int, buckets: int, batch_bytes: int = 6 << 20) -> DataFrame:
    """(k1, k2, at): where a rolling block occurs as a fixed block at another place."""
    block = (window + 1) // 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", batch_bytes):
                words = find_words(*text_buffer(batch.column("text")), SPACED)
                place, h = windows(words.hashes(), words.first, block)
                doc = words.doc_of()[place]
                # a document that is shorter than a window has none to look for
                long = words.counts()[doc] >= window
                place, h, doc = place[long], h[long], doc[long]
                at, keys = place - words.first[doc], _keys(batch)
                group, n = grouped(h)
                fixed = at % block == 0
                anchored = np.bincount(group[fixed], minlength=n)[group]
                # a block that rolls by twice is a repeat too; fixed places alone are witnesses
                known = (anchored > fixed) | ~fixed & (np.bincount(group, minlength=n)[group] > 1)
                sent = ~known | first_of(group, n, fixed)
                found = list(pack(keys, doc[sent], at[sent], h[sent], bucket_of(h[sent], buckets), 4))
                found += settled(keys, doc, at, known, window - block + 1, buckets)
                if found:
                    yield _blobs(found)

    def judge(at: np.ndarray, h: np.ndarray) -> np.ndarray:
        group, n = grouped(h)
        fixed = at % block == 0
        return np.bincount(group[fixed], minlength=n)[group] > fixed

    return hits(docs.select("k1", "k2", "text").mapInArrow(emit, ROWS), 4, buckets, judge)


def _marks(cells: list[bytes | None], n: np.ndarray, reach: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words (of all documents in a row) within ``reach`` before or after given positions."""
    first = np.r_[0, np.cumsum(n)]
    step = np.zeros(int(first[-1]) + 1, np.int64)
    for d, cell in enumerate(cells):
        if cell:
            at = np.frombuffer(cell, "<u4").astype(np.int64)
            low, high = (np.maximum(at - reach + 1, 0), at + 1) if back else (at, np.minimum(at + reach, n[d]))
            np.add.at(step, first[d] + low, 1)
            np.add.at(step, first[d] + high, -1)
    return np.cumsum(step[:-1]) > 0, first


def repeats(docs: DataFrame, found: DataFrame, window: int, buckets: int, batch_bytes: int = 4 << 20) -> DataFrame:
    """(k1, k2, at): where windows start that start at another place too."""
    block = (window + 1) // 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", batch_bytes):
                words = find_words(*text_buffer(batch.column("text")), SPACED)
                place, h = windows(words.hashes(), words.first, window)
                near, _ = _marks(batch.column("at").to_pylist(), words.counts(), window - block + 1, True)
                keep = near[place]
                place, h = place[keep], h[keep]
                doc = words.doc_of()[place]
                at, keys = place - words.first[doc], _keys(batch)
                group, n = grouped(h)
                known = np.bincount(group, minlength=n)[group] > 1
                sent = ~known | first_of(group, n)
                packed = list(pack(keys, doc[sent], at[sent], h[sent], bucket_of(h[sent], buckets), 8))
                packed += settled(keys, doc, at, known, window, buckets)
                if packed:
                    yield _blobs(packed)

    def judge(at: np.ndarray, h: np.ndarray) -> np.ndarray:
        group, n = grouped(h)
        return np.bincount(group, minlength=n)[group] > 1

    return hits(docs.join(found, ["k1", "k2"]).select("doc_id", "text", "k1", "k2", "at").mapInArrow(emit, ROWS), 8, buckets, judge)


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept): ``spans`` are the removed
    runs of words (start, end), ``kept`` the words left, joined by one space."""
    buckets = buckets_for(docs, text_col, WORDS_PER_BYTE)
    keyed = with_keys(docs, id_col, text_col)  # shuffled by (k1, k2) once: both joins below read the same exchange
    starts = repeats(keyed, anchors(keyed, window, buckets), window, buckets)
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = find_words(*text_buffer(batch.column("text")), SPACED)
                n = words.counts()
                gone, first = _marks(batch.column("at").to_pylist(), n, window, False)
                total = np.r_[0, np.cumsum(gone)]
                removed = total[first[1:]] - total[first[:-1]]
                # kept words and one space after each, as one array of bytes
                left = np.flatnonzero(~gone)
                length = words.ends[left] - words.starts[left]
                padded = np.append(words.data, np.uint8(32))
                source = spread(words.starts[left], length + 1)
                ends = np.cumsum(length + 1)
                source[ends - 1] = len(words.data)
                data = padded[source].tobytes()
                stop = np.r_[0, ends][np.searchsorted(left, first)].tolist()
                texts = [data[a : max(a, b - 1)] for a, b in zip(stop, stop[1:])]
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                spans = [[] for _ in n]
                if len(edge):
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        while a < b:  # a run may go on in the next document
                            d = int(np.searchsorted(first, a, "right")) - 1
                            end = min(b, int(first[d + 1]))
                            spans[d].append({"start": a - int(first[d]), "end": end - int(first[d])})
                            a = end
                cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(spans, SPAN)]
                if with_text:
                    cols.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, NAMES[: len(cols)])

    SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"]
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept string" * with_text
    return keyed.join(starts, ["k1", "k2"], "left").select("doc_id", "text", "at").mapInArrow(cut, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
