import importlib


def test_registry(spark):
    entry = importlib.import_module("__spark_entry__")
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40
    assert entry.entry(spark).count() > 0
