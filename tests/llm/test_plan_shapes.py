"""What the plans promise: no shuffle where none is needed, no product, and only the columns that are used."""

import pytest

from graphloam.llm import queries

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_token_counts", "op3_license_scan", "op5_decontamination", "op7_sentencepiece"])
def test_one_pass_without_shuffle(spark, name):
    text = plan(queries.queries()[name](spark, DATA))
    assert "Exchange" not in text and "MapInArrow" in text
    assert "source#" not in text.split("FileScan")[1].split("]")[0]


@pytest.mark.parametrize("name", ["op1_language_id", "op4_quality", "op6_jaccard_join", "op8_sharding", "op9_vector_dedup", "op10_substring_dedup"])
def test_no_products(spark, name):
    text = plan(queries.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_every_number_has_one_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracles()) <= set(names)


def test_oracles_of_exact_operators(spark):
    """The SQL on the smallest tables."""
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.oracles().items():
        mine, theirs = queries.queries()[name](spark, DATA), c.sql(sql)
        columns = sorted(mine.columns)
        assert columns == sorted(theirs.columns), name
        at = [theirs.columns.index(x) for x in columns]
        assert sorted(str([r[x] for x in columns]) for r in mine.collect()) == sorted(str([r[i] for i in at]) for r in theirs.fetchall()), name
