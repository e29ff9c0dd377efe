"""What one task holds does not grow with the dataset."""

from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from sparkloom import session
from sparkloom.operators import maintenance
from sparkloom.plans import queries
from sparkloom.sources.files import Dataset

SF = "/root/testdata/sf0.001"


def rows_of_tasks(spark, path):
    """Rows that each task wrote, by the task's number in the names of files."""
    read = spark.read.parquet(path).groupBy(F.regexp_extract("_metadata.file_name", r"part-(\d+)-", 1).alias("t")).count()
    return sorted(r["count"] for r in read.collect())


def test_repartition_spreads_rows_over_tasks(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(8000).selectExpr("id", "id % 2 as p", "0 as q").write.partitionBy("p").parquet(path)
    maintenance.maintain(spark, "repartition", path, partition_by=["q"], max_rows=1000)
    assert max(rows_of_tasks(spark, path)) < 2000
    assert spark.read.parquet(path).agg(F.countDistinct("id"), F.sum("id"), F.count("p")).first() == (8000, 7999 * 4000, 8000)


def test_order_places_rows_without_a_window_over_them(spark):
    plan = queries.QUERIES["order_dataset"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_order_of_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintenance, "RUN_ROWS", 10, raising=False)
    for name, by, good in [("a", "id", True), ("b", "CASE WHEN id = 30 THEN 29 WHEN id = 29 THEN 30 ELSE id END", False), ("c", "id div 7", True)]:
        spark.range(0, 100, 1, 1).selectExpr(f"{by} as k").write.parquet(f"{tmp_path}/{name}")
        assert maintenance.in_order(spark.read.parquet(f"{tmp_path}/{name}"), ["k"]) is good


def test_optimize_and_deduplicate_scale_their_shuffles(spark, tmp_path, monkeypatch):
    name, seen, first = "spark.sql.shuffle.partitions", [], maintenance.first_of_keys
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(maintenance, "first_of_keys", lambda *a: seen.append(int(spark.conf.get(name))) or first(*a))
    was = spark.conf.get(name)
    for op, keys in (("optimize", "dedup_keys"), ("deduplicate", "keys")):
        path = str(tmp_path / op)
        spark.range(4000).selectExpr("id % 3000 as id", "0 as p").write.partitionBy("p").parquet(path)
        maintenance.maintain(spark, op, path, **{keys: ["id"]}, max_rows=500)
        assert spark.read.parquet(path).select("id").distinct().count() == spark.read.parquet(path).count() == 3000
        assert max(rows_of_tasks(spark, path)) < 1000
    assert seen == [40, 40] and spark.conf.get(name) == was


def test_compaction_neither_shuffles_nor_sorts(spark, tmp_path, monkeypatch):
    path, plans, swap = str(tmp_path / "d"), [], Dataset.swap
    spark.range(900).selectExpr("id", "concat('a b/', id % 3) as p").repartition(3).write.partitionBy("p").parquet(path)

    def watched(self, old, frames, *rest):
        plans.extend(df._jdf.queryExecution().toString() for df in (frames.values() if isinstance(frames, dict) else frames))
        return swap(self, old, frames, *rest)

    monkeypatch.setattr(Dataset, "swap", watched)
    before = Counter(map(tuple, Dataset(spark, path).read().select("id", "p").collect()))
    done = maintenance.maintain(spark, "compact", path)
    assert len(done.created) == 3 and plans and not any("Exchange" in p or "Sort" in p for p in plans)
    assert Counter(map(tuple, Dataset(spark, path).read().select("id", "p").collect())) == before


def test_small_files_are_cut_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 500, raising=False)
    path = queries.small_files(spark, SF)
    assert max(rows_of_tasks(spark, path)) < 1500
