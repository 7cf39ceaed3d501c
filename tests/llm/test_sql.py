"""The queries that have SQL against it, on the small tables."""

import duckdb
import pytest

from turnlens.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    frame = queries.QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in frame.collect()) == sorted(found.fetchall())
