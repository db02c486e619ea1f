"""Sources are dealt over the cores before they are parsed, and parsed once."""

import __spark_entry__ as entry
from graphloam.plans import rendered

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_dealt(spark):
    for files in (rendered.sources, rendered.pieces):
        text = plan(files(spark, DATA).select("content"))
        assert "RepartitionByExpression [p_partkey" in text


def test_graphs_parse_once(spark):
    for name in ("built_nodes", "built_edges", "dropped_edges"):
        assert plan(entry.queries()[name](spark, DATA)).count("MapInArrow") == 0  # they read the parsed files' table


def test_chunks_parse_once(spark):
    for name in ("built_chunks", "chunk_counts", "stored_chunks"):
        assert plan(entry.queries()[name](spark, DATA)).count("MapInArrow") == 0
