"""Unifying, casting and inferring schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
#: Texts that stand for no value. Inference gives the types users expect only
#: with just these.
NULL_WORDS = ["-", "", "None", "none", "NONE", "NaN", "Nan", "nan", "NAN", "N/A", "n/a", "null", "Null", "NULL"]


def common_type(types: list[T.DataType]) -> T.DataType | None:
    """The type that values of all given types go to; None: none but text holds them."""
    kinds = [t for t in types if not isinstance(t, T.NullType)]
    if not kinds:
        return T.StringType()
    if all(t == kinds[0] for t in kinds):
        return kinds[0]
    if all(isinstance(t, tuple(WHOLE)) for t in kinds):
        return max(kinds, key=lambda t: WHOLE.index(type(t)))
    if all(isinstance(t, (*WHOLE, T.FloatType, T.DoubleType)) for t in kinds):
        return T.DoubleType() if any(isinstance(t, T.DoubleType | T.LongType) for t in kinds) else T.FloatType()
    if all(isinstance(t, (*WHOLE, T.DecimalType)) for t in kinds):
        tens = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else ([3, 5, 10, 19][WHOLE.index(type(t))], 0) for t in kinds]
        scale = max(s for _, s in tens)
        return T.DecimalType(min(38, max(w for w, _ in tens) + scale), scale)
    if all(isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType) for t in kinds):
        return T.TimestampType() if any(isinstance(t, T.TimestampType) for t in kinds) else T.TimestampNTZType()
    if all(isinstance(t, T.ArrayType) for t in kinds):
        inner = common_type([t.elementType for t in kinds])
        return T.ArrayType(inner) if inner else None
    if all(isinstance(t, T.StructType) for t in kinds):
        return unify(kinds)
    return None


def unify(schemas: list[T.StructType], remove_conflicting: bool = False) -> T.StructType:
    """One schema for all: columns in order of first appearance. Conflicts become text, or go."""
    seen: dict[str, list[T.StructField]] = {}
    for schema in schemas:
        for f in schema.fields:
            seen.setdefault(f.name, []).append(f)
    out = []
    for name, fields in seen.items():
        found = common_type([f.dataType for f in fields])
        if found is None and remove_conflicting:
            continue
        nullable = len(fields) < len(schemas) or any(f.nullable for f in fields)
        out.append(T.StructField(name, found or T.StringType(), nullable, fields[0].metadata if len(fields) == 1 else None))
    return T.StructType(out)


def zones_by_majority(schemas: list[T.StructType]) -> dict[str, T.DataType]:
    """By time column, whether most schemas have it with a zone (an instant) or without; with
    one if as many do as do not."""
    counts: dict[str, int] = {}
    for schema in schemas:
        for f in schema.fields:
            if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
                counts[f.name] = counts.get(f.name, 0) + (1 if isinstance(f.dataType, T.TimestampType) else -1)
    return {name: T.TimestampType() if n >= 0 else T.TimestampNTZType() for name, n in counts.items()}


def same_zones(frames: list[DataFrame], zone: str | None = "auto") -> list[DataFrame]:
    """Frames whose time columns all are instants or all have no zone: auto as most have them,
    null without one, a name: instants, where times without a zone are local times of it.
    Instants without a zone show the time of UTC."""
    wanted = zones_by_majority([df.schema for df in frames])

    def one(df: DataFrame, f: T.StructField):
        own = F.col(f"`{f.name}`")
        if f.name not in wanted or not isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            return own
        goal = wanted[f.name] if zone == "auto" else T.TimestampNTZType() if zone is None else T.TimestampType()
        if goal == f.dataType:
            return own
        if isinstance(goal, T.TimestampNTZType):
            return F.convert_timezone(None, F.lit("UTC"), own.cast("timestamp_ntz")).alias(f.name)
        local = F.lit("UTC" if zone == "auto" else zone)
        return F.convert_timezone(local, F.current_timezone(), own).cast("timestamp").alias(f.name)

    return [df.select(*[one(df, f) for f in df.schema.fields]) for df in frames]


def cast_to(df: DataFrame, schema: T.StructType, extra: bool = True, strict: bool = True) -> DataFrame:
    """Columns of the schema (typed nulls where missing), then the others if ``extra``.
    Not strict: values that do not fit become null."""
    cols = []
    for f in schema.fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            own = F.col(f"`{f.name}`")
            cols.append((own.cast(f.dataType) if strict else own.try_cast(f.dataType)).alias(f.name))
    return df.select(*cols, *[F.col(f"`{c}`") for c in df.columns if extra and c not in schema.names])


def union_all(frames: list[DataFrame], remove_conflicting: bool = False) -> DataFrame:
    """All rows by name, under the unified schema."""
    goal = unify([df.schema for df in frames], remove_conflicting)
    first, *rest = [cast_to(df, goal, extra=False) for df in frames]
    for df in rest:
        first = first.unionAll(df)
    return first


#: Promotions that keep every value.
LOSSLESS = {(a, b) for i, a in enumerate(WHOLE) for b in WHOLE[i + 1 :]} | {(T.FloatType, T.DoubleType), (T.DateType, T.TimestampNTZType)}


def lossless(old: T.DataType, new: T.DataType) -> bool:
    if old == new or (type(old), type(new)) in LOSSLESS:
        return True
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return lossless(old.elementType, new.elementType)
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return old.names == new.names and all(lossless(a.dataType, b.dataType) for a, b in zip(old.fields, new.fields))
    return False


def lost_values(df: DataFrame, schema: T.StructType) -> dict[str, int]:
    """By column, how many values a cast to the schema would change; one pass."""
    changed = [f for f in schema.fields if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
    if not changed:
        return {}

    def bad(f: T.StructField):
        own, back = F.col(f"`{f.name}`"), df.schema[f.name].dataType
        return own.isNotNull() & ~F.coalesce(own.try_cast(f.dataType).try_cast(back).eqNullSafe(own), F.lit(False))

    row = df.agg(*[F.count_if(bad(f)).alias(f.name) for f in changed]).first()
    return {k: v for k, v in row.asDict().items() if v}


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without columns that hold no value; all stay if there are no rows."""
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df if not row["__rows"] else df.select(*[F.col(f"`{c}`") for c in df.columns if row[c]])


def infer_dtypes(df: DataFrame, columns: list[str] | None = None, null_words: list[str] = NULL_WORDS, shrink: bool = False) -> DataFrame:
    """Text columns as whole numbers, numbers, booleans, dates or timestamps if every value
    is one; judged on all rows in one pass. ``shrink``: whole numbers as narrow as they fit."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not names:
        return df

    def clean(c: str):
        t = F.trim(F.col(f"`{c}`"))
        return F.when(~t.isin(null_words), t)

    tests = {
        "long": lambda t: t.rlike(r"^[+-]?\d{1,19}$") & t.try_cast("long").isNotNull(),
        "double": lambda t: F.regexp_replace(t, ",", ".").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
        "boolean": lambda t: F.lower(t).isin("true", "false", "yes", "no", "ja", "nein"),
        "date": lambda t: t.rlike(r"^\d{4}-\d{2}-\d{2}$") & t.try_cast("date").isNotNull(),
        "timestamp": lambda t: t.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}") & t.try_cast("timestamp").isNotNull(),
    }
    aggs = []
    for i, c in enumerate(names):
        t = clean(c)
        aggs.append(F.count(t).alias(f"{i}_n"))
        aggs += [F.count_if(test(t)).alias(f"{i}_{k}") for k, test in tests.items()]
        aggs += [F.min(t.try_cast("long")).alias(f"{i}_min"), F.max(t.try_cast("long")).alias(f"{i}_max")]
    row, out = df.agg(*aggs).first(), {}
    for i, c in enumerate(names):
        n, t = row[f"{i}_n"], clean(c)
        kind = next((k for k in tests if n and row[f"{i}_{k}"] == n), None)
        if kind == "long" and shrink:
            low, high = row[f"{i}_min"], row[f"{i}_max"]
            kind = next(k for k, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("long", 63)) if -(1 << bits) <= low and high < 1 << bits)
        if kind == "double":
            t = F.regexp_replace(t, ",", ".").cast("double")
        elif kind == "boolean":
            t = F.lower(t).isin("true", "yes", "ja")
        elif kind:
            t = t.cast(kind)
        out[c] = t
    return df.withColumns(out)
