import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.predicates import predicate, table_names


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, 1.5, "a", True), (2, math.nan, "b", False), (3, None, None, None), (31, 40.0, "c", True)], "i int, x double, s string, b boolean")


def ids(df, where, **more):
    return sorted(r.i for r in df.where(predicate(where, df.schema, **more)).collect())


@pytest.mark.parametrize(
    "where, want",
    [
        ("i >= 2 AND i < 31", [2, 3]),
        ("i > 30.5", [31]),
        ("x > 1", [1, 31]),
        ("x IS NULL", [2, 3]),
        ("x IS NOT NULL", [1, 31]),
        ("s IN ('a', 'c')", [1, 31]),
        ("s NOT IN ('a')", [2, 31]),
        ("NOT (i = 1 OR s = 'b')", [31]),
        ("b IS TRUE", [1, 31]),
        ("i = -5 OR (i <> 2 AND i <= 3)", [1, 3]),
        ([("i", ">", 1), ("s", "in", ["b", "c"])], [2, 31]),
        ([[("i", "=", 1)], [("x", ">=", 40.0)]], [1, 31]),
        (None, [1, 2, 3, 31]),
    ],
)
def test_rows(df, where, want):
    assert ids(df, where) == want


def test_not_in_may_keep_nulls(df):
    assert ids(df, "s NOT IN ('a')", nulls="keep") == [2, 3, 31]


def test_column(df):
    assert ids(df, F.col("i") == 1) == [1]


@pytest.mark.parametrize("where", ["nope = 1", "i LIKE '1%'", "abs(i) = 1", [("nope", "=", 1)], [("i", "~", 1)]])
def test_refused(df, where):
    with pytest.raises(ValueError):
        predicate(where, df.schema)


def test_not_strict(df):
    assert ids(df, "abs(i) = 1", strict=False) == [1]


def test_pushed_down(df, spark, tmp_path):
    df.write.parquet(str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    plan = back.where(predicate("i >= 2 AND s IN ('a')", back.schema)).select("i")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(i,2)" in plan


def test_table_names(spark):
    assert table_names("WITH c AS (SELECT * FROM a) SELECT * FROM c JOIN b.d ON true") == ["a", "b.d"]
