import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import keys, maintenance
from sparkloom.operators.merge import merge_dataset, merge_frames
from sparkloom.sources.files import Dataset, DriftError
from sparkloom.sources.read import file_stats, read_files
from sparkloom.sources.write import write_dataset, write_files
from sparkloom.streaming.batches import each_batch


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("strategy, want", [("insert", {1: "a", 2: "b", None: "n", 3: "s"}), ("update", {1: "a", 2: "t", None: "u"}), ("upsert", {1: "a", 2: "t", None: "u", 3: "s"})])
def test_merge_null_keys(spark, strategy, want):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(2, 1, "x"), (2, 2, "t"), (None, 3, "u"), (3, 4, "s")], "k int, o int, v string")
    out = merge_frames(target, keys.dedupe(source, ["k"], ["o"], "last").drop("o"), ["k"], strategy)
    assert {r.k: r.v for r in out.collect()} == want


def test_nan_keys(spark):
    t, s = spark.createDataFrame([(math.nan, 1), (1.0, 2)], "k double, v int"), spark.createDataFrame([(math.nan, 9)], "k double, v int")
    assert sorted(r.v for r in merge_frames(t, s, ["k"]).collect()) == [2, 9]


@pytest.mark.parametrize("strategy", ["full_merge", "deduplicate", "x"])
def test_unknown_strategy(spark, strategy):
    df = spark.range(1)
    with pytest.raises(ValueError):
        merge_frames(df, df, ["id"], strategy)


def dataset(spark, path, part=None):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("p"), F.lit("old").alias("v"))
    write_dataset(df.repartitionByRange(5, "id"), path, partition_by=part)
    return df


def test_merge_touches_only_needed_files(spark, tmp_path):
    path = str(tmp_path / "d")
    dataset(spark, path)
    before = Dataset(spark, path).files()
    source = spark.createDataFrame([(3, "0", "new"), (500, "1", "new")], "id long, p string, v string")
    r = merge_dataset(spark, path, source, ["id"])
    assert (r.inserted, r.updated, len(r.rewritten_files)) == (1, 1, 1)
    assert set(r.preserved_files) == set(before) - set(r.rewritten_files)
    back = spark.read.parquet(path)
    assert back.count() == 101 and back.where("v = 'new'").count() == 2


def test_merge_limits(spark, tmp_path):
    path = str(tmp_path / "d")
    dataset(spark, path, ["p"])
    with pytest.raises(ValueError, match="partition"):
        merge_dataset(spark, path, spark.createDataFrame([(3, "2", "new")], "id long, p string, v string"), ["id"])
    with pytest.raises(ValueError, match="does not exist"):
        merge_dataset(spark, str(tmp_path / "none"), spark.range(2), ["id"], "update")
    assert merge_dataset(spark, path, spark.createDataFrame([], "id long, p string, v string"), ["id"]).inserted == 0


@pytest.mark.parametrize("fail_at", [0, 3, 7])
def test_failed_move_leaves_all_as_it_was(spark, tmp_path, fail_at):
    path = str(tmp_path / "d")
    df = dataset(spark, path, ["p"])
    before = Dataset(spark, path).infos()
    plan = maintenance.plan_compaction(spark, path)
    with pytest.raises(OSError):
        maintenance.execute(spark, plan, fail_at=fail_at)
    assert [(f.path, f.size) for f in Dataset(spark, path).infos()] == [(f.path, f.size) for f in before]
    assert rows(spark.read.parquet(path).select("id", "p", "v")) == rows(df)


def test_drift(spark, tmp_path):
    path = str(tmp_path / "d")
    dataset(spark, path)
    data = Dataset(spark, path)
    old = [type(f)(f.path, f.size + 1, f.modified, f.partition) for f in data.infos()]
    with pytest.raises(DriftError):
        data.swap(data.files(), [data.read()], [], snapshot=old)
    assert spark.read.parquet(path).count() == 100


def test_maintenance(spark, tmp_path):
    path = str(tmp_path / "d")
    df = dataset(spark, path, ["p"])
    done = maintenance.maintain(spark, "compact", path)
    assert len(done.created) == 3 and rows(spark.read.parquet(path).select("id", "p", "v")) == rows(df)
    write_dataset(df.where("id < 10"), path, partition_by=["p"])
    done = maintenance.maintain(spark, "deduplicate", path, keys=["id"])
    assert (done.rows_before, done.rows_after) == (110, 100)
    maintenance.maintain(spark, "order", path, sort_by=["-id"], max_rows=20)
    assert maintenance.in_order(spark.read.parquet(path), ["-id"], ["p"]) and file_stats(spark, path).agg(F.max("n_rows")).first()[0] <= 20
    maintenance.maintain(spark, "repartition", path, partition_by=["v"])
    assert Dataset(spark, path).partition_columns() == ["v"] and spark.read.parquet(path).count() == 100
    goal = T.StructType.fromDDL("id int, p string")
    with pytest.raises(ValueError, match="lossless"):
        maintenance.maintain(spark, "rewrite_schema", path, schema=goal)
    maintenance.maintain(spark, "rewrite_schema", path, schema=goal, policy="safe")
    assert spark.read.parquet(path).schema["id"].dataType == T.IntegerType()


def test_partition_prefixes_are_whole(spark, tmp_path):
    path = str(tmp_path / "d")
    write_dataset(spark.createDataFrame([(1, 1), (2, 10)], "a int, p int"), path, partition_by=["p"])
    assert [f.partition for f in Dataset(spark, path).infos(["p=1"])] == ["p=1"]


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "d")
    r = write_dataset(spark.range(95), path, max_rows_per_file=10)
    assert r.n_rows == 95 and len(r.files) >= 10 and r.n_bytes > 0
    assert write_dataset(spark.range(3), path, mode="overwrite").n_rows == 3 and spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        write_dataset(spark.range(3), path, codec="zip")
    write_files([spark.range(2), spark.range(2)], str(tmp_path / "u"), "csv", unique=True)
    assert read_files(spark, str(tmp_path / "u"), "csv").count() == 2
    with pytest.raises(FileNotFoundError):
        read_files(spark, str(tmp_path / "nothing"))
    assert sum(b.count() for b in read_files(spark, path, batch_size=1)) == 3


def test_stream_of_files(spark, tmp_path):
    path, seen = str(tmp_path / "d"), []
    write_dataset(spark.range(40).repartition(4), path)
    for _ in range(2):
        each_batch(spark, path, spark.range(1).schema, lambda df, i: seen.append(df.count()), str(tmp_path / "c"), 1)
    assert sum(seen) == 40


def test_compaction_keeps_columns_and_partition_names(spark, tmp_path):
    """Files of differing columns and types; partitions spelled with zeros, under Spark's own inference."""
    path, name = f"{tmp_path}/mixed", "spark.sql.sources.partitionColumnTypeInference.enabled"
    spark.conf.set(name, "true")
    try:
        for i, (p, cols) in enumerate([("01", "id as a"), ("01", "cast(id as int) as a, cast(id as string) as b"), ("02", "id as a"), ("02", "id as a, 'x' as b")]):
            spark.range(i * 10, i * 10 + 10).selectExpr(*[c.strip() for c in cols.split(", ")]).coalesce(1).write.mode("append").parquet(f"{path}/p={p}")
        maintenance.maintain(spark, "compact", path)
        data = Dataset(spark, path)
        assert sorted({f.partition for f in data.infos()}) == ["p=01", "p=02"] and len(data.files()) == 2
        rows = sorted(map(tuple, data.read().select("a", "b", "p").collect()))
        assert rows == sorted((i, str(i) if 10 <= i < 20 else "x" if i >= 30 else None, "01" if i < 20 else "02") for i in range(40))
        spark.range(3).selectExpr("'t' as a").coalesce(1).write.mode("append").parquet(f"{path}/p=02")
        before = data.files()
        with pytest.raises(ValueError, match="holds all values"):
            maintenance.maintain(spark, "compact", path)
        assert data.files() == before
    finally:
        spark.conf.set(name, "false")


def test_empty_folders_go_and_order_holds_across_files(spark, tmp_path):
    path = f"{tmp_path}/moved"
    spark.range(100).selectExpr("id % 4 as p", "id", "-id as v").write.partitionBy("p").parquet(path)
    maintenance.maintain(spark, "repartition", path, partition_by=["q"], derived={"q": F.expr("id % 2")})
    assert sorted(x.name for x in Path(path).iterdir() if x.is_dir()) == ["q=0", "q=1"]
    flat = f"{tmp_path}/flat"
    spark.range(200).selectExpr("id % 7 as a", "id as b").repartition(4).write.parquet(flat)
    assert not maintenance.in_order(spark.read.parquet(flat), ["a", "-b"])
    maintenance.maintain(spark, "order", flat, sort_by=["a", "-b"], target_bytes=1500)
    assert len(Dataset(spark, flat).files()) > 1
    assert maintenance.in_order(spark.read.parquet(flat), ["a", "-b"])
    assert not maintenance.in_order(spark.read.parquet(flat), ["-a"])


def test_gates_refuse_what_breaks_the_promise(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    spark.createDataFrame([(i % 3, -i) for i in range(9)], "k int, v int").repartition(2).write.parquet(path)
    before = sorted(spark.read.parquet(path).collect())
    files = maintenance.Dataset(spark, path).files()
    monkeypatch.setattr(maintenance, "first_of_keys", lambda df, *_: df)
    with pytest.raises(ValueError, match="equal"):
        maintenance.maintain(spark, "deduplicate", path, keys=["k"])
    gate = maintenance._gate(maintenance.plan_repartition(spark, path, ["p"], {"p": F.col("k") + 1}), ["p"])
    assert gate(spark.createDataFrame([(1, "2"), (None, None)], "k int, p string")) is None
    assert "folder" in gate(spark.createDataFrame([(1, "1")], "k int, p string"))
    monkeypatch.setattr(maintenance, "in_order", lambda *_: False)
    with pytest.raises(ValueError, match="order"):
        maintenance.maintain(spark, "order", path, sort_by=["v"])
    assert sorted(spark.read.parquet(path).collect()) == before and maintenance.Dataset(spark, path).files() == files
