"""Joins and dedup on keys where null equals null and NaN equals NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_keys(keys: list[str], left: str = "l", right: str = "r") -> Column:
    """Planned by Spark as an equi-join on (coalesced key, is null)."""
    return reduce(Column.__and__, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys])


def matching(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in ``other``."""
    return df.alias("l").join(other.select(*keys).alias("r"), same_keys(keys), "left_semi")


def missing_from(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``other``."""
    return df.alias("l").join(other.select(*keys).alias("r"), same_keys(keys), "left_anti")


def delta(df: DataFrame, other: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` that ``other`` does not have, judged by ``subset``; repeats stay."""
    return missing_from(df, other, subset or [c for c in df.columns if c in other.columns])


def ordering(order_by: list[str | Column]) -> list[Column]:
    """"-name" falls; NaN, then null, come last either way."""
    out: list[Column] = []
    for o in order_by:
        if isinstance(o, Column):
            out.append(o)
            continue
        down, name = o.startswith("-"), o.lstrip("-")
        own = F.col(f"`{name}`")
        out += [own.isNull().asc(), own.desc() if down else own.asc()]
    return out


def dedupe(df: DataFrame, keys: list[str], order_by: list[str | Column], keep: str = "first") -> DataFrame:
    """One row for each key: the first, or the last, in the given order. For a total result
    the order must have no ties within a key."""
    order = ordering(order_by)
    if keep == "last":
        cols = [o if isinstance(o, Column) else F.col(f"`{o.lstrip('-')}`") for o in order_by]
        order = [x for o, c in zip(order_by, cols) for x in ((c.desc_nulls_first(),) if not (isinstance(o, str) and o.startswith("-")) else (c.asc_nulls_first(),))]
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def dedupe_any(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(keys) if keys else df.dropDuplicates()
