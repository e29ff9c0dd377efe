"""Every query of the library with SQL gives the rows that the SQL gives."""

from collections import Counter

import duckdb
import pytest

from sparkloom.plans.queries import ORACLES, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, name):
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    order = sorted(columns)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == order
    rows = Counter(tuple(x[columns.index(c)] for c in order) for x in want.fetchall())
    assert Counter(tuple(r[c] for c in order) for r in df.collect()) == rows
