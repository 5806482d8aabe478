import duckdb
import pytest

import __spark_entry__ as entry
from webskein import registry

TABLES = "documents pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() == 50


def plain(v):
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, db, name):
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = db.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(str([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(str([plain(r[i]) for i in places]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
