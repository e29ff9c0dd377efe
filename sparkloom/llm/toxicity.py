"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the distinct hashes of its lower-cased words, word pairs and
skip-grams (a word and the one after next), into ``2 ** bits`` slots. Fitting runs in one
task over at most about ``max_rows`` labelled rows, picked by a hash of their id (the
documented bound; all labelled rows where there are fewer). L1 leaves few weights, of
2 ** bits at most, so they are broadcast; scoring reads every row, with no shuffle.

Defined results. Null or wordless text: the score of the bias alone. Null label or id:
not used in fitting, yet scored. Repeated ids: each row is scored; a repeated label row
counts each time. No labelled rows at all: the weights are empty and scores are 0.5.
One class only: the bias learns it. Other columns of the input pass through unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bytewords import ALNUM, BASE, M1, U, find_words, mix, slices, text_buffer
from sparkloom.llm.shared import table

BIAS = -1


@dataclass(frozen=True)
class Ftrl:
    bits: int = 22
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    epochs: int = 3
    max_rows: int = 12_000
    seed: int = 17


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word, pair and skip-gram; repeats within a row included."""
    words = find_words(*text_buffer(column), ALNUM, lower=True)
    h, doc = words.hashes(), words.doc_of()
    rows, slots = [doc], [h]
    for gap, salt in ((1, U(3)), (2, U(5))):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            rows.append(doc[gap:][same])
            slots.append(mix(h[:-gap][same] * BASE + h[gap:][same] * M1 + salt))
    return np.concatenate(rows), (np.concatenate(slots) >> U(64 - bits)).astype(np.int64)


def fit_rows(rows: list[tuple[np.ndarray, float]], p: Ftrl) -> dict[int, float]:
    """Weights by slot after ``epochs`` passes in the given order."""
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)  # the last slot is the bias, without L1
    l1 = np.float64(p.l1)
    for _ in range(p.epochs):
        for slots, label in rows:
            zi, ni = z[slots], n[slots]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((p.beta + root) / p.alpha + p.l2), 0.0)
            bias = -z[-1] / ((p.beta + math.sqrt(n[-1])) / p.alpha)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + bias)))) - label
            z[slots] += g - (np.sqrt(ni + g * g) - root) / p.alpha * w
            n[slots] = ni + g * g
            z[-1] += g - (math.sqrt(n[-1] + g * g) - math.sqrt(n[-1])) / p.alpha * bias
            n[-1] += g * g
    kept = np.flatnonzero(np.abs(z[:-1]) > l1)
    w = -(z[kept] - np.sign(z[kept]) * l1) / ((p.beta + np.sqrt(n[kept])) / p.alpha + p.l2)
    return dict(zip(kept.tolist(), w.tolist())) | {BIAS: -z[-1] / ((p.beta + math.sqrt(n[-1])) / p.alpha)}


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, params: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[int, float]:
    """``may_learn``: a condition on ``doc_id`` of the label rows to learn from."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & may_learn)
    total = known.count()
    share = min(1.0, params.max_rows / max(total, 1))
    picked = F.pmod(F.xxhash64("doc_id", F.lit(params.seed)), F.lit(1 << 30))
    known = known.withColumn("rank", picked).where(F.col("rank") < int(share * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("rank", "doc_id", "label", "text")  # some max_rows rows of three numbers
    bits = params.bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                row, slot = features(batch.column("text"), bits)
                key = np.unique(row << bits | slot)
                ends = np.searchsorted(key >> bits, np.arange(batch.num_rows + 1))
                low = (key & ((1 << bits) - 1)).astype("<u4")
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([low[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["rank", "doc_id", "label", "slots"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.frombuffer(s, "<u4").astype(np.int64), y) for b in batches for y, s in zip(b.column("label").to_pylist(), b.column("slots").to_pylist())]
        w = fit_rows(got, params) if got else {}
        yield pa.RecordBatch.from_pydict({"slot": pa.array(list(w), pa.int32()), "weight": pa.array(list(w.values()), pa.float64())})

    found = rows.mapInArrow(extract, f"rank long, doc_id {docs.schema[id_col].dataType.simpleString()}, label double, slots binary")
    weights = found.repartition(1).sortWithinPartitions("rank", "doc_id", "label", "slots").mapInArrow(learn, "slot int, weight double")
    return {r.slot: r.weight for r in weights.collect()}


def scores(column: pa.Array, slots: np.ndarray, known: np.ndarray, values: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """A score of every text; ``known``: by slot, whether it has a weight."""
    row, slot = features(column, bits)
    hit = np.flatnonzero(known[slot])
    key = np.unique(row[hit] << bits | slot[hit])
    w = values[np.searchsorted(slots, key & ((1 << bits) - 1))] if len(key) else np.zeros(0)
    total = np.bincount(key >> bits, w, len(column)) + bias
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _scored_batches(spark: SparkSession, weights: dict[int, float], bits: int, text_col: str, make):
    slots = np.array(sorted(k for k in weights if k != BIAS), np.int64)
    shared = spark.sparkContext.broadcast((slots, np.array([weights[k] for k in slots.tolist()]), weights.get(BIAS, 0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values, bias = shared.value
        known = np.zeros(1 << bits, bool)
        known[slots] = True
        for whole in batches:
            for batch in slices(whole, text_col):
                yield make(batch, scores(batch.column(text_col), slots, known, values, bias, bits))

    return run


def score(docs: DataFrame, weights: dict[int, float], params: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    run = _scored_batches(docs.sparkSession, weights, params.bits, "text", lambda batch, s: pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"]))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, weights: dict[int, float], limit: float = 0.5, params: Ftrl = Ftrl(), text_col: str = "text") -> DataFrame:
    """The rows, as they are, that score below the limit."""
    return docs.mapInArrow(_scored_batches(docs.sparkSession, weights, params.bits, text_col, lambda batch, s: batch.filter(pa.array(s < limit))), docs.schema)


def held_out(col: Column) -> Column:
    return F.crc32(col.cast("string")) % 5 == 0


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> dict[int, float]:
    return fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, trained(spark, sf_dir, docs))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
