"""Every registered query against the same question in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA
from mostrador.plans import registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def comparable(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert got
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert comparable(df.columns, got) == comparable(names, result.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_has_every_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
