def test_entry_and_registry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 100
