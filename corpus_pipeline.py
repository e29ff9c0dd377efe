"""A corpus pipeline of five operators: documents in, token-id files out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, jaccard, mixing, tokenids, toxicity
from sparkloom.llm.shared import stored, table

#: Every leaf once, and a tenth more tokens dealt out by the target weights.
MIX = mixing.Mix(budget=1.1, weights=mixing.PRODUCTION.weights, min_epochs=1, max_epochs=2)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.keep_clean(docs, toxicity.trained(spark, sf_dir, docs))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links stays."""
    return jaccard.keep_one(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of leaves that are due more come twice."""
    return mixing.mix(docs, MIX)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document, as read back from the files: where its ids start, how many, their CRC-32."""
    return tokenids.encoded(docs, spell_special=False)


STAGES = [
    ("toxicity", toxic_out),
    ("n-gram Jaccard join", near_copies_out),
    ("benchmark decontamination", benchmark_out),
    ("mixing sources to target weights", mixed),
    ("token-ID output", token_ids),
]
#: A fitted classifier, a tokenizer and a file format are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
