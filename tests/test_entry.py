import __spark_entry__ as e


def test_registered():
    q = e.queries()
    assert len(q) >= 44 and set(e.oracle_sql()) <= set(q)


def test_flagship(spark):
    assert e.entry(spark).count() > 0
