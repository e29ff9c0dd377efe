"""Reading CSV, JSON and Parquet files, of one schema or many."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.predicates import predicate
from sparkloom.functions.schemas import infer_dtypes, union_all

FORMATS = ("csv", "json", "parquet")


def expand(spark: SparkSession, paths: str | list[str], format: str) -> list[str]:
    """Files behind paths, directories and globs, in order."""
    jvm, out = spark._jvm, []
    for p in [paths] if isinstance(paths, str) else paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in fs.globStatus(path) or []:
            if not s.isDirectory():
                out.append(s.getPath().toString())
                continue
            it = fs.listFiles(s.getPath(), True)
            while it.hasNext():
                f = it.next().getPath()
                if f.getName().endswith((f".{format}", f".{format}l", f".{format}.gz")) and f.getName()[0] not in "_.":
                    out.append(f.toString())
    if not out:
        raise FileNotFoundError(f"no {format} files at {paths}")
    return sorted(out)


def _one(spark: SparkSession, files: list[str], format: str, lines: bool, options: dict) -> DataFrame:
    reader = spark.read.options(**options)
    if format == "csv":
        return reader.options(**({"header": True, "inferSchema": True} | options)).csv(files)
    if format == "json":
        return reader.option("multiLine", not lines).json(files)
    return reader.parquet(*files)


def read_files(spark: SparkSession, paths: str | list[str], format: str = "parquet", include_file_path: bool = False, json_lines: bool = True, infer: bool = False, batch_size: int | None = None, remove_conflicting: bool = False, **options) -> DataFrame | Iterator[DataFrame]:
    """All rows under one unified schema. Files are grouped by their own schema; each group
    is one scan, cast and united, as a scan cannot promote types by itself. ``batch_size``:
    a frame for so many files each, in order."""
    if format not in FORMATS:
        raise ValueError(f"Unsupported format: {format}")
    files = expand(spark, paths, format)
    if batch_size:
        parts = [files[i : i + batch_size] for i in range(0, len(files), batch_size)]
        return (read_files(spark, p, format, include_file_path, json_lines, infer, None, remove_conflicting, **options) for p in parts)
    with ThreadPoolExecutor(16) as pool:
        schemas = list(pool.map(lambda f: _one(spark, [f], format, json_lines, options).schema, files))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for f, s in zip(files, schemas):
        groups.setdefault(s.json(), (s, []))[1].append(f)
    frames = []
    for schema, members in groups.values():
        reader = spark.read.schema(schema).options(**({"header": True} | options if format == "csv" else options))
        reader = reader.option("multiLine", not json_lines) if format == "json" else reader
        df = reader.format(format).load(members)
        path = F.col("_metadata.file_path").alias("file_path")
        frames.append(df.select(path, "*") if include_file_path and format == "parquet" else df.select("*", path) if include_file_path else df)
    df = union_all(frames, remove_conflicting)
    return infer_dtypes(df) if infer else df


def read_dataset(spark: SparkSession, path: str, columns: list[str] | None = None, filters: str | list | Column | None = None, schema: T.StructType | None = None, format: str = "parquet", nulls: str = "sql", strict: bool = True) -> DataFrame:
    """A lazy scan of a dataset; the filter may use columns that are not returned."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.format(format).load(path)
    if filters is not None:
        df = df.where(predicate(filters, df.schema, nulls, strict))
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def file_stats(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows and bytes of each file, and for given columns the least, the greatest, nulls."""
    df = spark.read.parquet(path)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns or []:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls")]
    return df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("n_bytes"), *(columns or [])).groupBy("file_path", "n_bytes").agg(*aggs)


def sql(spark: SparkSession, query: str, tables: dict[str, DataFrame | str], args: dict | list | None = None) -> DataFrame:
    """A query over frames or Parquet paths, registered under the given names."""
    for name, t in tables.items():
        (spark.read.parquet(t) if isinstance(t, str) else t).createOrReplaceTempView(name)
    return spark.sql(query, args=args) if args else spark.sql(query)
