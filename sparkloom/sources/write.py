"""Writing frames as files and datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.files import Dataset

#: The codec names that users may give.
CODECS = ("snappy", "gzip", "lz4", "zstd", "brotli", "uncompressed", "none")
MODES = {"append": "append", "overwrite": "overwrite", "error_if_exists": "errorifexists", "delete_matching": "overwrite"}


@dataclass(frozen=True)
class WriteResult:
    files: list[str]
    n_rows: int
    n_bytes: int


def checked_codec(codec: str) -> str:
    if codec.lower() not in CODECS:
        raise ValueError(f"Unsupported codec: {codec}")
    return codec.lower()


def write_dataset(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None, max_rows_per_file: int = 5_000_000, codec: str = "snappy") -> WriteResult:
    """Adds files, or replaces all data files (others stay), as one step. No file has more
    than the given rows."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode must be append or overwrite, not {mode}")
    if gone := [c for c in partition_by or [] if c not in df.columns]:
        raise ValueError(f"partition columns not in the data: {gone}")
    data = Dataset(df.sparkSession, path)
    with_codec = df.sparkSession.conf.get("spark.sql.parquet.compression.codec")
    df.sparkSession.conf.set("spark.sql.parquet.compression.codec", checked_codec(codec))
    try:
        new = data.swap(data.files() if mode == "overwrite" else [], [df], partition_by or [], max_rows_per_file)
    finally:
        df.sparkSession.conf.set("spark.sql.parquet.compression.codec", with_codec)
    sizes = {f.path: f.size for f in data.infos()}
    rows = df.sparkSession.read.parquet(*new).count() if new else 0
    return WriteResult(new, rows, sum(sizes[f] for f in new))


def write_files(df: DataFrame | list[DataFrame], path: str, format: str = "parquet", mode: str = "append", unique: bool | list[str] = False, one_file: bool = False, **options) -> None:
    """A directory of files. ``unique``: without repeated rows, by all or some columns."""
    if format not in ("csv", "json", "parquet"):
        raise ValueError(f"Unsupported format: {format}")
    if mode not in MODES:
        raise ValueError(f"Unsupported mode: {mode}")
    if isinstance(df, list):
        from sparkloom.functions.schemas import union_all

        df = union_all(df)
    if unique:
        df = df.dropDuplicates(unique if isinstance(unique, list) else None)
    df = df.coalesce(1) if one_file else df
    df.write.mode(MODES[mode]).options(**({"header": True} if format == "csv" else {}) | options).format(format).save(path)


def column_document(df: DataFrame) -> DataFrame:
    """One row, one JSON text: an object with an array of each column's values. For small
    frames only, as it is one value."""
    row = F.collect_list(F.struct(*df.columns))
    return df.agg(row.alias("r")).select(F.to_json(F.struct(*[F.col(f"r.{c}").alias(c) for c in df.columns])).alias("value"))
