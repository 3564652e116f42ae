"""Every query with SQL against DuckDB; every other one runs and has rows."""

import os
from collections import Counter

import pytest

from lociweave.plans import catalog as plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _norm(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, bool | str):
        return str(x)
    try:
        return f"{float(x):.6f}"
    except TypeError:
        return str(x)[:10]


def _rows(frame):
    return Counter(tuple(map(_norm, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), duck.sql(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
