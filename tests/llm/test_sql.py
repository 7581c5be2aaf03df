"""Every query with SQL gives the SQL's rows, over the whole tables."""

import os
from collections import Counter

import duckdb
import pytest

from tests.conftest import SF
from voxloom.llm import queries

DIR = os.environ.get("QUERY_SF_DIR", SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    want = con.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    right = Counter(tuple(r[k] for k in order) for r in want.fetchall())
    got = queries.queries()[name](spark, DIR)
    assert sorted(got.columns) == names
    assert Counter(tuple(r) for r in got.select(*names).collect()) == right and right
