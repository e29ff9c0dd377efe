"""Physical maintenance of Parquet datasets: plan, stage, check, publish.

A plan is a frozen list of groups of files, made from a listing alone. Executing it reads
the groups, stages what replaces them, compares rows (and what the operation promises),
makes sure that no file changed meanwhile, and swaps files as one step with rollback.
Work is done by Spark's shuffles and sorts, so no group has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.schemas import cast_to, lossless, lost_values
from sparkloom.operators.keys import ordering
from sparkloom.session import scaled
from sparkloom.sources.files import Dataset, FileInfo


@dataclass(frozen=True)
class Group:
    partition: str
    files: tuple[FileInfo, ...]


@dataclass(frozen=True)
class Plan:
    operation: str
    path: str
    groups: tuple[Group, ...]
    skipped: tuple[str, ...] = ()
    max_rows: int = 5_000_000
    target_bytes: int = 128 << 20
    options: dict = field(default_factory=dict)

    @property
    def snapshot(self) -> list[FileInfo]:
        return [f for g in self.groups for f in g.files]


@dataclass(frozen=True)
class Outcome:
    operation: str
    rows_before: int
    rows_after: int
    retired: list[str]
    created: list[str]
    skipped: tuple[str, ...] = ()


def _by_partition(files: list[FileInfo]) -> dict[str, list[FileInfo]]:
    out: dict[str, list[FileInfo]] = {}
    for f in files:
        out.setdefault(f.partition, []).append(f)
    return out


def _whole(spark: SparkSession, operation: str, path: str, prefixes: list[str] | None, **more) -> Plan:
    files = Dataset(spark, path).infos(prefixes)
    if not files:
        raise FileNotFoundError(f"no Parquet files at {path}")
    return Plan(operation, path, tuple(Group(p, tuple(f)) for p, f in _by_partition(files).items()), **more)


def plan_compaction(spark: SparkSession, path: str, target_bytes: int = 128 << 20, max_rows: int = 5_000_000, prefixes: list[str] | None = None) -> Plan:
    """Files below the target, smallest first, in groups that reach about the target. Files
    that would be alone stay as they are."""
    files = Dataset(spark, path).infos(prefixes)
    if not files:
        raise FileNotFoundError(f"no Parquet files at {path}")
    groups, skipped = [], []
    for part, members in _by_partition(files).items():
        current, size = [], 0
        for f in sorted(members, key=lambda f: (f.size, f.path)):
            if f.size >= target_bytes:
                skipped.append(f.path)
                continue
            if current and size + f.size > target_bytes:
                groups.append(Group(part, tuple(current)))
                current, size = [], 0
            current.append(f)
            size += f.size
        if current:
            groups.append(Group(part, tuple(current)))
    skipped += [g.files[0].path for g in groups if len(g.files) == 1]
    return Plan("compaction", path, tuple(g for g in groups if len(g.files) > 1), tuple(skipped), max_rows, target_bytes)


def plan_deduplication(spark: SparkSession, path: str, keys: list[str] | None = None, order_by: list[str] | None = None, prefixes: list[str] | None = None, max_rows: int = 5_000_000) -> Plan:
    """Within each partition, the first row of each key."""
    return _whole(spark, "deduplication", path, prefixes, max_rows=max_rows, options={"keys": keys, "order_by": order_by or []})


def plan_repartition(spark: SparkSession, path: str, partition_by: list[str], derived: dict[str, Column] | None = None, dedup_keys: list[str] | None = None, order_by: list[str] | None = None, max_rows: int = 5_000_000) -> Plan:
    """All rows, or the first of each key in the whole dataset, under new partition columns."""
    return _whole(spark, "repartition", path, None, max_rows=max_rows, options={"partition_by": partition_by, "derived": derived or {}, "keys": dedup_keys, "order_by": order_by or []})


def plan_ordered_compaction(spark: SparkSession, path: str, sort_by: list[str], max_rows: int = 5_000_000, prefixes: list[str] | None = None, target_bytes: int = 128 << 20) -> Plan:
    """Each partition as one sorted run, cut into files."""
    return _whole(spark, "ordered compaction", path, prefixes, max_rows=max_rows, target_bytes=target_bytes, options={"sort_by": sort_by})


def plan_schema_rewrite(spark: SparkSession, path: str, schema: T.StructType, policy: str = "strict", max_rows: int = 5_000_000) -> Plan:
    """strict: lossless promotions only; safe: casts that change no value; loose: any cast,
    values that do not fit become null."""
    if policy not in ("strict", "safe", "loose"):
        raise ValueError(f"policy must be strict, safe or loose, not {policy}")
    return _whole(spark, "schema rewrite", path, None, max_rows=max_rows, options={"schema": schema, "policy": policy})


def plan_optimize(spark: SparkSession, path: str, dedup_keys: list[str] | None = None, order_by: list[str] | None = None, target_bytes: int = 128 << 20, max_rows: int = 5_000_000) -> Plan:
    """Deduplication within partitions and compaction, published once."""
    return _whole(spark, "optimize", path, None, max_rows=max_rows, target_bytes=target_bytes, options={"keys": dedup_keys, "order_by": order_by or []})


def first_of_keys(df: DataFrame, keys: list[str] | None, order_by: list[str], within: list[str]) -> DataFrame:
    """The first row of each key; equal ones in order of file and row."""
    own = df.withColumns({"__f": F.col("_metadata.file_path"), "__r": F.col("_metadata.row_index")})
    by = [F.col(f"`{k}`") for k in [*within, *(keys or [c for c in df.columns if c not in within])]]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*ordering(order_by), "__f", "__r"))
    return own.withColumn("__n", rank).where("__n = 1").drop("__n", "__f", "__r")


def sort_columns(sort_by: list[str], schema: T.StructType) -> list[Column]:
    """"-name" falls; NaN goes with null, last."""
    out = []
    for s in sort_by:
        name = s.lstrip("+-")
        own = F.col(f"`{name}`")
        if isinstance(schema[name].dataType, T.FloatType | T.DoubleType):
            own = F.when(~F.isnan(own), own)
        out.append(own.desc_nulls_last() if s.startswith("-") else own.asc_nulls_last())
    return out


def _due(rows: int, size: int, plan: Plan) -> int:
    """Files that are due for so many rows: none above the target or the most rows."""
    return max(1, round(size / plan.target_bytes), -(-rows // plan.max_rows))


def _sized(df: DataFrame, part: list[str], n: int, spread: list[Column]) -> DataFrame:
    """As many tasks as files are due, each with a range of partitions; a large partition is
    cut by a hash of ``spread``, which tells rows apart."""
    own = [F.col(f"`{p}`") for p in part]
    return df.repartitionByRange(n, *own, F.xxhash64(*spread)) if n > 1 else df.coalesce(1) if not part else df.repartition(*own)


def _compacted(data: Dataset, plan: Plan, schema: T.StructType, part: list[str]) -> dict[str, DataFrame]:
    """By partition, a task for each group. Each stays in its partition's folder, so nothing
    is shuffled or sorted and a task holds no more than its writer's buffers."""
    out: dict[str, DataFrame] = {}
    for g in plan.groups:
        own = data.read([f.path for f in g.files], schema=schema).drop(*part).coalesce(1)
        folder = "/".join(p for p in g.partition.split("/") if "=" in p)
        out[folder] = out[folder].unionAll(own) if folder in out else own
    return out


def execute(spark: SparkSession, plan: Plan, fail_at: int | None = None) -> Outcome:
    data = Dataset(spark, plan.path)
    old = [f.path for f in plan.snapshot]
    if not old:
        return Outcome(plan.operation, 0, 0, [], [], plan.skipped)
    part = data.partition_columns()
    schema = data.schema(old)
    df = data.read(old, schema=schema)
    before, size = df.count(), sum(f.size for f in plan.snapshot)
    with scaled(spark, before, size):
        expect, frames, part = _planned(data, plan, df, before, size, part)
        created = data.swap(old, frames, part, plan.max_rows, expect, plan.snapshot, fail_at, _gate(plan, part))
    return Outcome(plan.operation, before, expect, old, created, plan.skipped)


def _planned(data: Dataset, plan: Plan, df: DataFrame, before: int, size: int, part: list[str]) -> tuple[int, list[DataFrame] | dict[str, DataFrame], list[str]]:
    """How many rows replace the old ones, those rows, and their partition columns."""
    o = plan.options
    if plan.operation == "compaction":
        return before, _compacted(data, plan, df.schema, part), part
    if plan.operation in ("deduplication", "optimize", "repartition"):
        by, spread = o.get("partition_by", part), [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
        kept = df
        if o["keys"] or plan.operation == "deduplication":
            within = [] if plan.operation == "repartition" else part
            kept, spread = first_of_keys(df, o["keys"], o["order_by"], within), [F.col(f"`{k}`") for k in o["keys"] or df.columns]
        expect = before if kept is df else kept.count()
        return expect, [_sized(kept.withColumns(o.get("derived", {})), by, _due(expect, size, plan), spread)], by
    if plan.operation == "ordered compaction":
        own = df.withColumns({"__f": F.col("_metadata.file_path"), "__r": F.col("_metadata.row_index")})
        order = [*[F.col(f"`{p}`") for p in part], *sort_columns(o["sort_by"], df.schema), F.col("__f"), F.col("__r")]
        # ranges of (partition, sort columns): a large partition is cut into several sorted runs
        ranged = own.repartitionByRange(_due(before, size, plan), *order)
        return before, [ranged.sortWithinPartitions(*order).drop("__f", "__r")], part
    return before, [_rewritten(df, o["schema"], o["policy"], part)], part


def _gate(plan: Plan, part: list[str]) -> Callable[[DataFrame], str | None] | None:
    """What an operation promises, judged on the staged files before they are published: no
    key twice, rows in order, rows in the folder of their derived keys."""
    o = plan.options

    def judge(staged: DataFrame) -> str | None:
        keys = o.get("keys")
        if keys:
            within = part if plan.operation != "repartition" else []
            if not staged.groupBy(*[F.col(f"`{c}`") for c in dict.fromkeys([*within, *keys])]).count().where("count > 1").isEmpty():
                return f"rows with equal {keys} are left"
        if plan.operation == "ordered compaction" and not in_order(staged, o["sort_by"], part):
            return f"rows are not in order of {o['sort_by']}"
        for name, value in o.get("derived", {}).items():
            # derived from the columns in the files, not from the folder itself
            if name in part and not staged.where(~F.col(f"`{name}`").eqNullSafe(F.nullif(value.cast("string"), F.lit("")))).isEmpty():
                return f"rows are not in the folder of their {name}"
        return None

    return judge if o.get("keys") or o.get("derived") or plan.operation == "ordered compaction" else None


def _rewritten(df: DataFrame, schema: T.StructType, policy: str, part: list[str]) -> DataFrame:
    own = T.StructType([f for f in df.schema.fields if f.name not in part])
    if sorted(schema.names) != sorted(own.names):
        raise ValueError("the target schema has other columns")
    if policy == "strict" and (bad := [f.name for f in schema.fields if not lossless(own[f.name].dataType, f.dataType)]):
        raise ValueError(f"not lossless: {bad}")
    if policy == "safe" and (lost := lost_values(df, schema)):
        raise ValueError(f"values would change: {lost}")
    return cast_to(df, schema, strict=policy != "loose")


#: Rows of a file that are judged as one run.
RUN_ROWS = 500_000


def in_order(df: DataFrame, sort_by: list[str], within: list[str] | None = None) -> bool:
    """Whether rows, by file and place in it, are sorted: each file in itself, and files of a
    partition (``within``) one after another. Files are judged in runs of ``RUN_ROWS`` rows:
    each run in itself, and of runs the first and last rows one after another."""
    columns = sort_columns(sort_by, df.schema)
    held = df.select(F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"), F.floor(F.col("_metadata.row_index") / RUN_ROWS).alias("__c"), *[f"`{c}`" for c in dict.fromkeys(s.lstrip("+-") for s in sort_by)], *[F.col(f"`{p}`").alias(f"__p{i}") for i, p in enumerate(within or [])])
    key = [F.row_number().over(Window.partitionBy("__f", "__c").orderBy(*columns, "__r")).alias("__n"), F.row_number().over(Window.partitionBy("__f", "__c").orderBy("__r")).alias("__m")]
    if not held.select(*key).where("__n <> __m").isEmpty():
        return False
    own = [f"__p{i}" for i in range(len(within or []))]
    names = [c for c in held.columns if c not in ("__f", "__r", "__c", *own)]
    edge = held.groupBy("__f", "__c", *own).agg(F.min_by(F.struct(*[f"`{c}`" for c in names]), "__r").alias("a"), F.max_by(F.struct(*[f"`{c}`" for c in names]), "__r").alias("z"))
    both = edge.select("__f", "__c", *own, F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("a").alias("k")), F.struct(F.lit(1).alias("e"), F.col("z").alias("k")))).alias("x")).select("__f", "__c", *own, "x.e", "x.k.*")
    ends = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(0))
    ranked = both.select(F.rank().over(ends.orderBy(*columns)).alias("n"), F.row_number().over(ends.orderBy("__f", "__c", "e")).alias("m"), F.count(F.lit(1)).over(ends.orderBy(*columns)).alias("last"))
    return ranked.where("m < n or m > last").isEmpty()


RUN: dict[str, Callable[..., Plan]] = {"compact": plan_compaction, "deduplicate": plan_deduplication, "repartition": plan_repartition, "order": plan_ordered_compaction, "rewrite_schema": plan_schema_rewrite, "optimize": plan_optimize}


def maintain(spark: SparkSession, operation: str, path: str, **options) -> Outcome:
    return execute(spark, RUN[operation](spark, path, **options))
