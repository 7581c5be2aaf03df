"""Queries of dense volumes against their SQL where the last volume is cut short: it has 1 to 7 of its 8 parts."""

from collections import Counter

import duckdb
import pytest

from tests.conftest import SF
from tests.test_queries import plain
from voxloom.plans import catalog


def cut(spark, folder, n):
    spark.read.parquet(f"{SF}/embeddings.parquet").where(f"vec_id < {n}").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def check(spark, name, folder):
    got = catalog.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    left = Counter(tuple(plain(r[c]) for c in names) for r in got.collect())
    right = Counter(tuple(plain(x) for x in r) for r in want.fetchall())
    assert left == right, (list((left - right).items())[:3], list((right - left).items())[:3])


@pytest.mark.parametrize("n", [41, 43, 45, 46])
def test_chunk_store(spark, tmp_path, n):
    check(spark, "ref03_chunk_store", cut(spark, tmp_path, n))


@pytest.mark.parametrize("n", [41, 43, 45, 46])
def test_patch_source(spark, tmp_path, n):
    check(spark, "ref10_patch_source", cut(spark, tmp_path, n))
