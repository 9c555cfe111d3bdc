"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from narrata.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, db, name):
    df = registry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql:
        cursor = db.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, cursor.fetchall())
    else:
        assert df.columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
