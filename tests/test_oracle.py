"""Every query of the registry against its SQL on the small tables."""

import math

import duckdb
import pytest

from turnlens.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(_norm(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql_but_topics():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"lda_topics", "topic_share_date", "topic_share_month"}
