"""Partition values in paths, and derived partition keys."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.frames import strftime

NULL_NAME = "__HIVE_DEFAULT_PARTITION__"


def partitions_from_path(path: str, scheme: str | list[str] = "hive") -> dict[str, str | None]:
    """hive: k=v folders; a list: names of the folders, in order."""
    folders = [p for p in path.split("/")[:-1] if p]
    if scheme == "hive":
        pairs = [p.split("=", 1) for p in folders if "=" in p]
        return {k: None if v == NULL_NAME else unquote(v) for k, v in pairs}
    names = list(scheme)
    return dict(zip(names, folders[-len(names) :]))


def partition_path(values: dict[str, object]) -> str:
    """Null and empty text share the folder that stands for no value, as Spark writes them."""
    return "/".join(f"{k}={NULL_NAME if v is None or v == '' else quote(str(v), safe='')}" for k, v in values.items())


def normalized_value(value: str | None) -> str | None:
    """Without outer blanks and quotes, and without backslashes."""
    return None if value is None else value.strip().strip("\"'").replace("\\", "")


def partition_values(paths: list[str], scheme: str | list[str] = "hive") -> dict[str, set[str | None]]:
    """The distinct values of each partition column that paths hold."""
    out: dict[str, set[str | None]] = {}
    for p in paths:
        for k, v in partitions_from_path(p, scheme).items():
            out.setdefault(k, set()).add(v)
    return out


def valid_partitions(values: dict[str, str | None], expected: list[str] | None = None) -> bool:
    """Whether there are partition columns, each with a name, and just the expected ones."""
    return bool(values) and all(values) and (expected is None or set(values) == set(expected))


def filter_paths(paths: list[str], wanted: dict[str, object], scheme: str | list[str] = "hive") -> list[str]:
    """Paths whose partition values are the wanted ones; a list: one of them."""
    want = {k: {None if x is None else str(x) for x in (v if isinstance(v, list | tuple | set) else [v])} for k, v in wanted.items()}
    return [p for p in paths if all(partitions_from_path(p, scheme).get(k, "\0") in v for k, v in want.items())]


def partitioning_scheme(paths: list[str]) -> dict:
    """The scheme and how sure that is, from the depth of key=value folders."""
    keys = [list(partitions_from_path(p)) for p in paths]
    if not paths or not all(k == keys[0] for k in keys) or not keys[0]:
        return {"scheme": "none", "columns": [], "confidence": 0.0}
    return {"scheme": "hive", "columns": keys[0], "confidence": min(1.0, len(keys[0]) / 3)}


def partition_condition(values: dict[str, object]) -> Column:
    out = F.lit(True)
    for k, v in values.items():
        out = out & F.col(f"`{k}`").eqNullSafe(F.lit(v))
    return out


def path_to_glob(path: str, format: str) -> str:
    return path if path.endswith(f".{format}") or "*" in path else f"{path.rstrip('/')}/**/*.{format}"


DERIVED = {"year": lambda c: F.year(c), "month": lambda c: F.month(c), "day": lambda c: F.day(c), "date": lambda c: F.to_date(c)}


def time_source(schema: T.StructType, column: str = "auto") -> str:
    """The column that keys derive from; auto: the only date or time column there is."""
    times = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType)]
    if column != "auto":
        if column not in times:
            raise ValueError(f"{column} is no date or time column")
        return column
    if len(times) != 1:
        raise ValueError(f"name one of the date or time columns {times}")
    return times[0]


def derived_key(column: str, kind: str, zone: str | None = None, schema: T.StructType | None = None) -> Column:
    """year, month, day, date or a strftime format of a time, in a zone if given. With a
    schema, ``column`` may be auto."""
    ts = F.col(f"`{time_source(schema, column) if schema else column}`")
    if zone:
        ts = F.from_utc_timestamp(ts, zone)
    return DERIVED[kind](ts) if kind in DERIVED else strftime(ts, kind)
