"""Every registered query against its SQL on the small tables, and the entry point's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def told(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.9g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(told(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def own_queries():
    from rayloom.plans.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", own_queries())
def test_query_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    said = duck.sql(sql)
    assert sorted(df.columns) == sorted(said.columns)
    assert rows(df.columns, found) == rows(said.columns, said.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
