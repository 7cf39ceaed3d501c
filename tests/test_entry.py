"""The driver's contract."""

import __spark_entry__


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns[0] == "fecha" and frame.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
