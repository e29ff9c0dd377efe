"""Keyed merge: as frames, and into a Parquet dataset where only touched files change."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.schemas import cast_to
from sparkloom.operators.keys import dedupe, matching, missing_from, same_keys
from sparkloom.sources.files import Dataset

STRATEGIES = ("insert", "update", "upsert")


@dataclass(frozen=True)
class MergeResult:
    strategy: str
    source_rows: int
    inserted: int
    updated: int
    deleted: int = 0
    rewritten_files: list[str] = field(default_factory=list)
    inserted_files: list[str] = field(default_factory=list)
    preserved_files: list[str] = field(default_factory=list)


def check(strategy: str, keys: list[str], source: DataFrame, target_columns: list[str] | None = None) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}, not {strategy}")
    if not keys:
        raise ValueError("no key columns")
    if gone := [k for k in keys if k not in source.columns]:
        raise ValueError(f"key columns not in the source: {gone}")
    if target_columns is not None and (extra := [c for c in source.columns if c not in target_columns]):
        raise ValueError(f"columns that the target does not have: {extra}")


def last_rows(source: DataFrame, keys: list[str], order_by: list | None) -> DataFrame:
    """The last row of each key; without an order, that of the rows as they come."""
    if order_by:
        return dedupe(source, keys, order_by, "last")
    return dedupe(source.withColumn("__seq", F.monotonically_increasing_id()), keys, ["__seq"], "last").drop("__seq")


def replaced(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows, with the source's values where keys match; a column that the source
    lacks keeps its value."""
    has = F.col("r.__has").isNotNull()
    cols = [F.when(has, F.col(f"r.`{c}`")).otherwise(F.col(f"l.`{c}`")).alias(c) if c in source.columns and c not in keys else F.col(f"l.`{c}`").alias(c) for c in target.columns]
    return target.alias("l").join(source.withColumn("__has", F.lit(True)).alias("r"), same_keys(keys), "left").select(*cols)


def merge_frames(target: DataFrame, source: DataFrame, keys: list[str], strategy: str = "upsert", order_by: list | None = None) -> DataFrame:
    """All rows of the target after the merge."""
    check(strategy, keys, source, target.columns)
    source = last_rows(source, keys, order_by)
    source = source.select(*[F.col(f"`{c}`").cast(target.schema[c].dataType).alias(c) for c in source.columns])
    kept = target if strategy == "insert" else replaced(target, source, keys)
    if strategy == "update":
        return kept
    return kept.unionByName(cast_to(missing_from(source, target, keys), target.schema, extra=False))


def merge_dataset(spark: SparkSession, path: str, source: DataFrame, keys: list[str], strategy: str = "upsert", order_by: list | None = None, partition_by: list[str] | None = None, max_rows: int = 5_000_000) -> MergeResult:
    """Merges into the dataset: files without a matching key stay as they are. Everything is
    written aside first and published as one step. A key may not change its partition."""
    check(strategy, keys, source)
    data = Dataset(spark, path)
    part = partition_by or data.partition_columns()
    source = last_rows(source, keys, order_by).persist()
    try:
        n = source.count()
        if not data.files():
            if strategy == "update":
                raise ValueError("nothing to update: the dataset does not exist")
            new = data.append(source, part, max_rows) if n else []
            return MergeResult(strategy, n, n, 0, inserted_files=new)
        target = data.read(with_file=True)
        check(strategy, keys, source, target.columns)
        if not n:
            return MergeResult(strategy, 0, 0, 0, preserved_files=data.files())
        source = source.select(*[F.col(f"`{c}`").cast(target.schema[c].dataType).alias(c) for c in source.columns])
        # files whose footers rule the keys out are not read: the range is pushed down
        scan = target
        spans = source.agg(*[f(F.col(f"`{k}`")).alias(f"{f.__name__}_{i}") for i, k in enumerate(keys) for f in (F.min, F.max)], *[F.count_if(F.col(f"`{k}`").isNull() | (F.col(f"`{k}`").cast("string") == "NaN")).alias(f"odd_{i}") for i, k in enumerate(keys)]).first()
        for i, k in enumerate(keys):
            if spans[f"min_{i}"] is not None and not spans[f"odd_{i}"]:
                scan = scan.where(F.col(f"`{k}`").between(F.lit(spans[f"min_{i}"]), F.lit(spans[f"max_{i}"])))
        hit = matching(scan.select("__file", *keys), source, keys)
        touched = [r[0] for r in hit.groupBy("__file").agg(F.lit(1)).select("__file").collect()]
        matched = hit.select(*keys).distinct().count()
        fresh = missing_from(source, scan, keys)
        if part and strategy != "insert" and all(p in source.columns for p in part):
            both = scan.alias("l").join(source.alias("r"), same_keys(keys))
            moved = ~F.lit(True)
            for p in part:
                moved = moved | ~F.col(f"l.`{p}`").cast("string").eqNullSafe(F.col(f"r.`{p}`").cast("string"))
            if not both.where(moved).isEmpty():
                raise ValueError("a matched key would change its partition")
        old = touched if strategy != "insert" else []
        inserts = cast_to(fresh, target.drop("__file").schema, extra=False) if strategy != "update" else None
        rewrites = replaced(data.read(old).select(*target.drop("__file").columns), source, keys) if old else None
        done = data.swap(old, [df for df in (rewrites, inserts) if df is not None], part, max_rows)
        kept = [f for f in data.files() if f not in done]
        inserted = n - matched if strategy != "update" else 0
        return MergeResult(strategy, n, inserted, matched if strategy != "insert" else 0, rewritten_files=old, inserted_files=done, preserved_files=kept)
    finally:
        source.unpersist()
