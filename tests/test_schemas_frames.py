import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import frames, partitions
from sparkloom.functions.schemas import cast_to, common_type, drop_null_columns, infer_dtypes, lossless, lost_values, unify, union_all, zones_by_majority


@pytest.mark.parametrize("types, want", [(["int", "bigint"], "bigint"), (["int", "string"], "string"), (["float", "int"], "float"), (["float", "bigint"], "double"), (["date", "timestamp_ntz"], "timestamp_ntz"), (["decimal(5,2)", "decimal(8,1)"], "decimal(9,2)"), (["array<int>", "array<bigint>"], "array<bigint>")])
def test_common_type(spark, types, want):
    found = common_type([T._parse_datatype_string(t) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(f"a {t}")["a"].dataType for t in types])
    assert (found or T.StringType()).simpleString() == want


def test_unify_and_union(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, n string"), spark.createDataFrame([(2**40, True)], "id long, e boolean")
    assert unify([a.schema, b.schema]).simpleString() == "struct<id:bigint,n:string,e:boolean>"
    assert sorted(union_all([a, b]).collect()) == sorted([(1, "x", None), (2**40, None, True)]) or len(union_all([a, b]).collect()) == 2
    c = spark.createDataFrame([("q",)], "id string")
    assert unify([a.schema, c.schema], remove_conflicting=True).names == ["n"]


def test_cast_and_losses(spark):
    df = spark.createDataFrame([(1, "5"), (300, "x")], "a int, b string")
    goal = T.StructType.fromDDL("b int, c date, a tinyint")
    assert cast_to(df, goal, strict=False).collect() == [(5, None, 1), (None, None, None)]
    assert lost_values(df, goal) == {"b": 1, "a": 1}
    assert lossless(T.IntegerType(), T.LongType()) and not lossless(T.LongType(), T.DoubleType())


def test_infer_keeps_every_row(spark):
    df = spark.createDataFrame([("1", "1,5", "true", "2024-01-02", "null", "x"), ("-7", "2", "no", None, "", "1")], "i string, f string, b string, d string, n string, s string")
    out = infer_dtypes(df, shrink=True)
    assert [t for _, t in out.dtypes] == ["tinyint", "double", "boolean", "date", "string", "string"]
    assert out.count() == 2 and out.first()["d"] == dt.date(2024, 1, 2)
    assert drop_null_columns(out).columns == ["i", "f", "b", "d", "s"]


def test_flatten_and_explode(spark):
    df = spark.sql("SELECT 1 AS id, struct(2 AS a, struct(3 AS c) AS b) AS s, array(1, 2) AS l UNION ALL SELECT 2, struct(4, struct(5)), array()")
    assert frames.unnest_all(df).columns == ["id", "s_a", "s_b_c", "l"]
    assert frames.explode_all(df).count() == 3


def test_time_columns(spark):
    days = [dt.datetime(y, m, d, 13, 47) for y in (2023, 2024) for m, d in ((1, 1), (1, 8), (2, 29 if y == 2024 else 28), (12, 31))]
    df = spark.createDataFrame([(x,) for x in days], "ts timestamp_ntz")
    got = df.select("ts", frames.week_of_year(F.col("ts")).alias("w"), frames.truncated(F.col("ts"), "15m").alias("q"), frames.truncated(F.col("ts"), "3mo").alias("m"), frames.strftime(F.col("ts"), "%Y/%m-%d %W").alias("f")).collect()
    for r in got:
        assert r.w == int(r.ts.strftime("%W")) and r.f == r.ts.strftime("%Y/%m-%d %W")
        assert r.q == r.ts.replace(minute=45) and r.m == dt.datetime(r.ts.year, (r.ts.month - 1) // 3 * 3 + 1, 1)


def test_row_count_without_groups(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    assert [r.row_nr for r in frames.with_row_count(df, ["k"]).orderBy("k").collect()] == list(range(1, 1001))


def test_partition_paths():
    p = partitions.partition_path({"a": None, "b": "x/y z"})
    assert partitions.partitions_from_path(p + "/f.parquet") == {"a": None, "b": "x/y z"}
    assert partitions.filter_paths(["p=1/f", "p=10/f"], {"p": 1}) == ["p=1/f"]


@pytest.mark.parametrize("text, to, want", [("1h", "short", "1h"), ("2 hours", "short", "2h"), ("3mo", "long", "3 month"), ("5 unknowns", "long", "5 unknown"), ("1invalid", "short", "1 invalid")])
def test_duration_text(text, to, want):
    assert frames.duration_text(text, to) == want


def test_time_from_text(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05+02:00",), ("2024-01-02 03:04:05",), ("2024-01-02",), ("x",), ("",), (None,)], "t string")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    rows = df.select(text(frames.time_from_text(F.col("t"))), text(frames.time_from_text(F.col("t"), "Asia/Tokyo")), text(frames.time_from_text(F.col("t"), "Asia/Tokyo", naive=True)), text(frames.time_from_text(F.col("t"), naive=True))).collect()
    assert rows[0] == ("2024-01-02 01:04:05", "2024-01-02 01:04:05", "2024-01-02 10:04:05", "2024-01-02 03:04:05")
    assert rows[1] == ("2024-01-02 03:04:05", "2024-01-01 18:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:05")
    assert rows[2] == ("2024-01-02 00:00:00", "2024-01-01 15:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:00")
    assert all(set(r) == {None} for r in rows[3:])


def test_zones_and_sources(spark):
    zoned, plain = T.StructType.fromDDL("t timestamp, a int"), T.StructType.fromDDL("t timestamp_ntz")
    assert zones_by_majority([zoned, plain]) == {"t": T.TimestampType()}
    assert zones_by_majority([zoned, plain, plain]) == {"t": T.TimestampNTZType()}
    assert partitions.time_source(zoned) == "t"
    with pytest.raises(ValueError):
        partitions.time_source(T.StructType.fromDDL("a int"))
    with pytest.raises(ValueError):
        partitions.time_source(zoned, "a")


def test_partition_values():
    paths = ["/d/a=1/b=x%20y/f.parquet", "/d/a=2/b=__HIVE_DEFAULT_PARTITION__/f.parquet"]
    assert partitions.partition_values(paths) == {"a": {"1", "2"}, "b": {"x y", None}}
    assert partitions.partition_values(["/d/2024/01/f"], ["y", "m"]) == {"y": {"2024"}, "m": {"01"}}
    assert partitions.filter_paths(paths, {"a": [1, 3]}) == paths[:1] and partitions.filter_paths(paths, {"b": None}) == paths[1:]
    assert partitions.normalized_value(" 'a\\b' ") == "ab" and partitions.normalized_value(None) is None
    assert partitions.valid_partitions({"a": "1"}, ["a"]) and not partitions.valid_partitions({"a": "1"}, ["b"]) and not partitions.valid_partitions({})
    assert partitions.partition_path({"a": "", "b": None, "c": "x/y"}) == "a=__HIVE_DEFAULT_PARTITION__/b=__HIVE_DEFAULT_PARTITION__/c=x%2Fy"


def test_partition_by(spark):
    df = spark.createDataFrame([(i, dt.datetime(2023 + i % 2, 1, 1 + i)) for i in range(5)], "id int, t timestamp_ntz")
    got = {k["year"]: sorted(r.id for r in f.collect()) for k, f in frames.partition_by(df, ["year"])}
    assert got == {2023: [0, 2, 4], 2024: [1, 3]}
    runs = [(k["row_run"], f.columns, f.count()) for k, f in frames.partition_by(df, rows=2, order_by=["id"])]
    assert runs == [(0, ["id", "t"], 2), (1, ["id", "t"], 2), (2, ["id", "t"], 1)]
    for wrong in ({"columns": ["nothing"]}, {"rows": 2}):
        with pytest.raises(ValueError):
            frames.partition_by(df, **wrong)
