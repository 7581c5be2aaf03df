"""Every query with SQL gives the SQL's rows, over the whole tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SF
from voxloom.plans import catalog

DIR = os.environ.get("QUERY_SF_DIR", SF)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    rows = got.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got.columns
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    left = Counter(tuple(plain(r[c]) for c in order) for r in rows)
    right = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert left == right, (list((left - right).items())[:3], list((right - left).items())[:3])
    assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
