"""Every core query against its SQL, on DuckDB over the same tables."""

import datetime
import math

import duckdb
import pytest

from tessera import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value) if isinstance(value, (float, bool)) else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = oracle.execute(queries.SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in cursor.description)
    assert got == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
