"""Helpers on frames: flattening, exploding, time columns, row numbers, splitting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: strftime codes and Spark's patterns for them.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%y": "yy", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "E", "%p": "a", "%I": "hh"}
UNITS = {"y": "year", "mo": "month", "w": "week", "d": "day", "h": "hour", "m": "minute", "s": "second"}


def unnest_all(df: DataFrame, separator: str = "_", keep: list[str] | None = None) -> DataFrame:
    """Struct fields as columns parent_child, all the way down; ``keep``: only these names."""

    def leaves(fields: list[T.StructField], path: list[str]):
        for f in fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, [*path, f.name])
            else:
                yield [*path, f.name]

    cols = [(separator.join(p), F.col(".".join(f"`{x}`" for x in p))) for p in leaves(df.schema.fields, [])]
    return df.select(*[c.alias(n) for n, c in cols if keep is None or n in keep])


def explode_all(df: DataFrame) -> DataFrame:
    """A row for each element of every array column, one column after another; empty and
    null arrays keep a row."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            df = df.select(*[F.explode_outer(f"`{c}`").alias(c) if c == f.name else F.col(f"`{c}`") for c in df.columns])
    return df


def timestamp_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType)]


def week_of_year(ts: Column) -> Column:
    """Weeks begin on Monday; days before the first Monday are in week 0."""
    return F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("int")


def strftime(ts: Column, pattern: str) -> Column:
    parts = [p for p in re.split(r"(%[A-Za-z])", pattern) if p]
    out = []
    for p in parts:
        if p == "%W":
            out.append(F.lpad(week_of_year(ts).cast("string"), 2, "0"))
        elif p in STRFTIME:
            out.append(F.date_format(ts, STRFTIME[p]))
        elif p.startswith("%"):
            raise ValueError(f"Unsupported format code: {p}")
        else:
            out.append(F.lit(p))
    return F.concat(*out)


def with_strftime_columns(df: DataFrame, column: str, formats: list[str]) -> DataFrame:
    return df.withColumns({f"_strftime_{f.replace('%', '').replace('-', '_')}_": strftime(F.col(column), f) for f in formats})


def truncated(ts: Column, duration: str) -> Column:
    """The start of the interval of so many units that holds the time: 15m, 1h, 2mo, ..."""
    m = re.fullmatch(r"(\d+)(mo|[ywdhms])", duration)
    if not m:
        raise ValueError(f"Not a duration: {duration}")
    n, unit = int(m[1]), UNITS[m[2]]
    if n == 1:
        return F.date_trunc(unit, ts)
    if unit in ("month", "year"):
        months = F.year(ts) * 12 + F.month(ts) - 1
        first = months - months % (n * (12 if unit == "year" else 1))
        return F.make_date(F.floor(first / 12).cast("int"), first % 12 + 1, F.lit(1)).cast("timestamp_ntz")
    seconds = n * {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    own = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(own - F.pmod(own, F.lit(seconds))).cast("timestamp_ntz")


def with_truncated_columns(df: DataFrame, column: str, durations: list[str]) -> DataFrame:
    return df.withColumns({f"_truncated_{d}_": truncated(F.col(column), d) for d in durations})


#: Short and long names of units of time.
LONG_UNITS = {"ns": "nanosecond", "us": "microsecond", "ms": "millisecond", "s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "mo": "month", "y": "year"}


def duration_text(duration: str, to: str = "short") -> str:
    """A duration with the short (1h) or the long name (1 hour) of its unit; one that is not
    known stays, apart from its number."""
    if to not in ("short", "long"):
        raise ValueError(f"to must be short or long, not {to}")
    number, unit = re.fullmatch(r"\s*(\d*)\s*(.*?)\s*", duration).groups()
    single = unit.removesuffix("s") or unit
    if to == "long":
        return f"{number} {LONG_UNITS.get(unit, single)}".strip()
    if unit in LONG_UNITS:
        return duration
    short = next((k for k, v in LONG_UNITS.items() if v == single), None)
    return f"{number}{short}" if short else f"{number} {unit}".strip()


OFFSET = r"(?i)(z|[+-]\d{2}:?\d{2})$"


def time_from_text(text: Column, zone: str | None = None, naive: bool = False) -> Column:
    """ISO 8601 texts as times: with an offset (Z, +02:00, +0200) the instant, without one the
    local time in ``zone`` (UTC if none). ``naive``: the time that clocks of the zone show
    (without a zone: that of the text), without zone. What is no time becomes null."""
    own = F.trim(text)
    tail = F.regexp_extract(F.when(own.contains(":"), own), OFFSET, 1)
    local = F.regexp_replace(own, OFFSET, "").try_cast("timestamp_ntz")
    local = F.when(tail == "", own.try_cast("timestamp_ntz")).otherwise(local)
    if naive and zone is None:
        return F.coalesce(local, own.try_cast("timestamp_ntz"))
    minutes = F.concat(F.substring(tail, 1, 1), F.lit("1")).try_cast("long") * (F.substring(tail, 2, 2).try_cast("int") * 60 + F.right(tail, F.lit(2)).try_cast("int"))
    micros = F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.coalesce(local, own.try_cast("timestamp_ntz"))).cast("timestamp"))
    shift = F.when(F.length(tail) > 1, minutes * 60_000_000).otherwise(F.lit(0))
    instant = F.timestamp_micros(micros - shift)
    if zone:
        in_zone = F.convert_timezone(F.lit(zone), F.current_timezone(), F.coalesce(local, own.try_cast("timestamp_ntz"))).cast("timestamp")
        instant = F.when(F.coalesce(F.length(tail), F.lit(0)) == 0, in_zone).otherwise(instant)
    return F.convert_timezone(None, F.lit(zone or "UTC"), instant.cast("timestamp_ntz")) if naive else instant


PARTS = {"year": F.year, "month": F.month, "week": week_of_year, "year_day": F.dayofyear, "day": F.day, "week_day": lambda c: F.date_format(c, "E"), "hour": F.hour, "minute": F.minute}


def with_datepart_columns(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    return df.withColumns({p: PARTS[p](F.col(column)) for p in parts})


def with_row_count(df: DataFrame, order_by: list, over: list[str] | None = None, name: str = "row_nr") -> DataFrame:
    """1, 2, ... in the given order. Without ``over`` the numbers come from counts of ranges
    of the order, so that rows stay spread over tasks."""
    if over:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*over).orderBy(*order_by)))
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (own + F.col("__before")).cast("long")).drop("__part", "__at", "__before")


def split_by(df: DataFrame, columns: list[str], most: int = 1000) -> list[tuple[dict, DataFrame]]:
    """(key, rows) for each distinct key; refuses more than ``most`` keys."""
    keys = df.select(*columns).distinct().limit(most + 1).collect()
    if len(keys) > most:
        raise ValueError(f"more than {most} keys; write with partitions instead")
    out = []
    for k in sorted(keys, key=str):
        cond = F.lit(True)
        for c in columns:
            cond = cond & F.col(c).eqNullSafe(F.lit(k[c]))
        out.append((k.asDict(), df.where(cond)))
    return out


def with_split_keys(df: DataFrame, columns: list[str] | None = None, time_column: str | None = None, formats: list[str] | None = None, durations: list[str] | None = None, rows: int | None = None, order_by: list | None = None) -> tuple[DataFrame, list[str]]:
    """The frame with the columns that it is to be split by, and their names: given columns,
    parts of a time (year, month, ...) that are not columns yet, formats and intervals of
    it, and numbers of runs of so many ``rows`` in an order, counted within the other keys."""
    names = list(columns or [])
    parts = [c for c in names if c not in df.columns]
    if unknown := [c for c in parts if c not in PARTS]:
        raise ValueError(f"neither columns nor parts of a time: {unknown}")
    if parts or formats or durations:
        found = timestamp_columns(df)
        time_column = time_column or (found[0] if found else None)
        if time_column is None:
            raise ValueError("no date or time column")
    df = with_datepart_columns(df, time_column, parts) if parts else df
    for with_keys, asked in ((with_strftime_columns, formats), (with_truncated_columns, durations)):
        if asked:
            before = df.columns
            df = with_keys(df, time_column, asked)
            names += [c for c in df.columns if c not in before]
    if rows:
        if not order_by:
            raise ValueError("runs of rows need an order")
        df = with_row_count(df, order_by, names or None, "__nr")
        df = df.withColumn("row_run", F.floor((F.col("__nr") - 1) / rows).cast("long")).drop("__nr")
        names.append("row_run")
    return df, names


def partition_by(df: DataFrame, columns: list[str] | None = None, most: int = 1000, **keys) -> list[tuple[dict, DataFrame]]:
    """(key, rows) for each key of ``with_split_keys``; the keys are not among the columns."""
    keyed, names = with_split_keys(df, columns, **keys)
    return [(k, rows.drop(*names)) for k, rows in split_by(keyed, names, most)] if names else [({}, df)]
