"""A directory of Parquet files: listing, reading, and swapping files with rollback.

All file access goes through Hadoop's FileSystem, so any store that Spark reads works.
Readers ignore names that begin with "_" or ".": new files are staged under such a name,
checked, and moved in; what they replace waits beside them until that is done.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.schemas import lossless, unify


class DriftError(RuntimeError):
    """Files changed between plan and publication."""


@dataclass(frozen=True)
class FileInfo:
    path: str
    size: int
    modified: int
    partition: str


class Dataset:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(self.root)

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def relative(self, path: str) -> str:
        return self._path(path).toUri().getPath().removeprefix(self.root.toUri().getPath()).strip("/")

    def infos(self, prefixes: list[str] | None = None) -> list[FileInfo]:
        """Data files in order; ``prefixes``: of whole path components below the root."""
        if not self.fs.exists(self.root):
            return []
        out, it = [], self.fs.listFiles(self.root, True)
        while it.hasNext():
            s = it.next()
            path = s.getPath().toString()
            rel = self.relative(path)
            if not rel.endswith(".parquet") or any(p[0] in "_." for p in rel.split("/")):
                continue
            part = rel.rpartition("/")[0]
            if prefixes is None or any(f"{part}/".startswith(f"{p.strip('/')}/") for p in prefixes):
                out.append(FileInfo(path, s.getLen(), s.getModificationTime(), part))
        return sorted(out, key=lambda f: f.path)

    def files(self) -> list[str]:
        return [f.path for f in self.infos()]

    def partition_columns(self) -> list[str]:
        first = next(iter(self.infos()), None)
        return [p.split("=", 1)[0] for p in first.partition.split("/") if "=" in p] if first else []

    def schema(self, files: list[str]) -> T.StructType:
        """One schema that holds every value of every file, partition columns last, as text
        as their folders spell them. Footers are merged by one distributed job; only where
        types differ are files looked at one by one. ``ValueError`` if no type holds all."""
        part = self.partition_columns()
        try:
            found = [self.spark.read.option("mergeSchema", True).parquet(*files).schema]
        except AnalysisException as e:
            # Spark merges no types, only columns
            if e.getCondition() not in ("CANNOT_MERGE_SCHEMAS", "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE", "FAILED_MERGE_SCHEMAS", "PARQUET_CANNOT_MERGE_SCHEMAS"):
                raise
            found = self._each(files)
        except Py4JJavaError:
            found = self._each(files)
        own = [T.StructType([f for f in s.fields if f.name not in part]) for s in found]
        goal = unify(own)
        lost = sorted({f.name for s in own for f in s.fields if not lossless(f.dataType, goal[f.name].dataType)})
        if lost:
            raise ValueError(f"no type holds all values of {lost}")
        return T.StructType([*goal.fields, *(T.StructField(p, T.StringType()) for p in part)])

    def _each(self, files: list[str]) -> list[T.StructType]:
        with ThreadPoolExecutor(16) as pool:
            return list(pool.map(lambda f: self.spark.read.parquet(f).schema, files))

    def read(self, files: list[str] | None = None, with_file: bool = False, schema: T.StructType | None = None) -> DataFrame:
        """The rows of the files under their common schema (``schema``)."""
        files = files or self.files()
        df = self.spark.read.option("basePath", self.root.toString()).schema(schema or self.schema(files)).parquet(*files)
        return df.withColumn("__file", F.col("_metadata.file_path")) if with_file else df

    def _stage(self, df: DataFrame, partition_by: list[str], max_rows: int, stage: str, name: str, folder: str = "") -> str:
        out = f"{self.root.toString()}/{stage}/{name}"
        writer = df.write.option("maxRecordsPerFile", max_rows)
        (writer.partitionBy(*partition_by) if partition_by and not folder else writer).parquet(f"{out}/{folder}".rstrip("/"))
        return out

    def append(self, df: DataFrame, partition_by: list[str] | None = None, max_rows: int = 5_000_000) -> list[str]:
        return self.swap([], [df], partition_by or [], max_rows)

    def swap(self, old: list[str], frames: list[DataFrame] | dict[str, DataFrame], partition_by: list[str], max_rows: int = 5_000_000, expect: int | None = None, snapshot: list[FileInfo] | None = None, fail_at: int | None = None, gate: Callable[[DataFrame], str | None] | None = None) -> list[str]:
        """Replaces files by what the frames hold (a dict: each under its partition's folder,
        without partition columns); returns the new ones. ``expect``: rows that
        must have been staged; ``snapshot``: files that must be as they were. On any error
        the dataset is as before. ``gate``: says what is wrong with staged rows, if anything;
        ``fail_at``: for tests, the move that fails."""
        stage = f"_staging_{uuid.uuid4().hex}"
        staged_root, moved, kept_aside = self._path(self.root.toString(), stage), [], []
        try:
            named = list(frames.items()) if isinstance(frames, dict) else [("", df) for df in frames]
            with ThreadPoolExecutor(8) as pool:
                outs = list(pool.map(lambda x: self._stage(x[1][1], partition_by, max_rows, stage, f"n{x[0]}", x[1][0]), enumerate(named)))
            if expect is not None:
                have = sum(self.spark.read.parquet(o).count() for o in outs)
                if have != expect:
                    raise ValueError(f"{have} rows staged, {expect} expected")
            for o, (_, df) in zip(outs, named):
                goal = {f.name: f.dataType for f in df.schema.fields if f.name not in partition_by}
                have_types = {f.name: f.dataType for f in self.spark.read.parquet(o).schema.fields if f.name not in partition_by}
                if self._listed(o) and goal != have_types:
                    raise ValueError(f"staged columns {sorted(have_types)} are not {sorted(goal)}")
                if gate and self._listed(o):
                    fields = [f for f in df.schema.fields if f.name not in partition_by]
                    fields += [T.StructField(p, T.StringType()) for p in partition_by]
                    if wrong := gate(self.spark.read.schema(T.StructType(fields)).parquet(o)):
                        raise ValueError(wrong)
            if snapshot is not None:
                now = {f.path: (f.size, f.modified) for f in self.infos()}
                if any(now.get(f.path) != (f.size, f.modified) for f in snapshot):
                    raise DriftError("files changed since the plan was made")
            new = [(s, f"{self.root.toString()}/{self._below(s, o)}") for o in outs for s in self._listed(o)]
            moves = 0
            for f in old:
                aside = f"{self.root.toString()}/{stage}/old/{self.relative(f)}"
                self._move(f, aside, moves == fail_at)
                kept_aside.append((f, aside))
                moves += 1
            for source, goal in new:
                self._move(source, goal, moves == fail_at)
                moved.append(goal)
                moves += 1
        except BaseException:
            for goal in moved:
                self.fs.delete(self._path(goal), False)
            for f, aside in kept_aside:
                self._move(aside, f, False)
            self.fs.delete(staged_root, True)
            raise
        self.fs.delete(staged_root, True)
        for folder in sorted({f.rpartition("/")[0] for f in old}, key=len, reverse=True):
            self._drop_empty(folder)
        self.spark.catalog.refreshByPath(self.root.toString())
        return sorted(moved)

    def _drop_empty(self, folder: str) -> None:
        """Removes a partition's folder, and those above it, once no file is left in it."""
        while self.relative(folder) and self.fs.exists(self._path(folder)) and not self.fs.listStatus(self._path(folder)):
            self.fs.delete(self._path(folder), False)
            folder = folder.rpartition("/")[0]

    def _below(self, path: str, out: str) -> str:
        return self._path(path).toUri().getPath().removeprefix(self._path(out).toUri().getPath()).strip("/")

    def _listed(self, out: str) -> list[str]:
        found, it = [], self.fs.listFiles(self._path(out), True)
        while it.hasNext():
            p = it.next().getPath().toString()
            if p.endswith(".parquet"):
                found.append(p)
        return sorted(found)

    def _move(self, source: str, goal: str, fail: bool) -> None:
        if fail:
            raise OSError("a move failed")
        target = self._path(goal)
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(self._path(source), target):
            raise OSError(f"cannot move {source} to {goal}")
