"""The driver contract."""

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rank" in df.columns
