"""Every query with SQL, against DuckDB on the smallest tables: names, types and values."""

import duckdb
import pytest

import __spark_entry__ as entry
from graphloam import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_matches_sql(spark, duck, name):
    mine = core.QUERIES[name](spark, DATA)
    theirs = duck.sql(core.ORACLES[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    kinds = dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    assert {c: TYPES[t] for c, t in mine.dtypes} == kinds
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in mine.collect()) == sorted(str([r[i] for i in at]) for r in theirs.fetchall())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "relationship" in out.columns


def test_every_core_query_is_registered():
    assert set(core.QUERIES) <= set(entry.queries()) and set(core.ORACLES) <= set(entry.oracle_sql())


def test_filters_and_columns_reach_the_scan(spark):
    plan = core.QUERIES["impact_callers_1hop"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "CartesianProduct" not in plan
