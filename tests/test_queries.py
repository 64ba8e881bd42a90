"""Each query against its DuckDB twin at the smallest scale."""

import math
import os

import duckdb
import pytest

from versefold.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return list(v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.TWINS))
def test_twin(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.TWINS[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    at = [want.columns.index(c) for c in columns]
    twins = [tuple(plain(r[k]) for k in at) for r in want.fetchall()]
    assert sorted(rows, key=repr) == sorted(twins, key=repr)


def test_all_have_twins():
    assert set(catalog.TWINS) == set(catalog.QUERIES)
