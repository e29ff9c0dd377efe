import importlib.util

import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).limit(1).count() == 1


def test_names():
    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) > 50
    if importlib.util.find_spec("sparkloom.llm"):
        assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
