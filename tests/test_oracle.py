"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import pytest

from siltstone.plans import core_queries


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view \"{os.path.basename(p)[:-8]}\" as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core_queries.SQL))
def test_matches(spark, sf, duck, name):
    got, want = core_queries.QUERIES[name](spark, sf).toPandas(), duck.execute(core_queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda d: sorted(map(repr, d[cols].astype(object).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(core_queries.QUERIES) - set(core_queries.SQL)))
def test_runs(spark, sf, name):
    core_queries.QUERIES[name](spark, sf).count()
