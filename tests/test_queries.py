"""Each query against its SQL on the smallest data set."""

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in __spark_entry__.plans.QUERIES)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    mine = [tuple(r) for r in got.collect()]
    assert mine
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        theirs = db.sql(sql)
        assert sorted(got.columns) == sorted(theirs.columns)
        assert rows(got.columns, mine) == rows(theirs.columns, theirs.fetchall())
