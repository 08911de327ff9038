"""Every traffic query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quern.plans.catalogue import ORACLE, QUERIES

FEW: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(x[i], 6) if isinstance(x[i], float) else x[i] for i in order) for x in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == FEW
