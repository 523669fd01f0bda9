import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() == 3
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(callable(f) for f in queries.values()) and all(isinstance(s, str) for s in sql.values())
