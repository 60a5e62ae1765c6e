"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from mirrorlake import registry
from mirrorlake.plans.sql import TABLES, plain_counts

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS FROM '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    frame = registry.queries()[name](spark, DATA)
    names = sorted(frame.columns)
    got = sorted((tuple(map(plain, r)) for r in frame.select(names).collect()), key=repr)
    rel = oracle.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    want = sorted((tuple(map(plain, r)) for r in rel.select(*names).fetchall()), key=repr)
    assert got == want


def test_counts_are_rewritten():
    assert plain_counts("SELECT count_if(a = f(b)) + 1") == "SELECT count(CASE WHEN a = f(b) THEN 1 END) + 1"
