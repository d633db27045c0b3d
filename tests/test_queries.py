"""Every registered query with SQL equals it, in names, types and values, over the smallest tables."""

import math
import os

import duckdb
import pytest

from marginalia import catalog, oracles, oracles_io

SQL = oracles.ORACLES | oracles_io.ORACLES
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf}/{name}.parquet"):
            con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def canon(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def test_each_query_has_sql():
    assert set(catalog.QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types)))
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(canon(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
