"""The star graph's edges: both kinds of pairs from one shuffle, repeated and null keys as in SQL."""

from graphloam.plans import star_graph

DATA = "/root/testdata/sf0.001"


def test_lines_are_shuffled_once(spark, monkeypatch):
    table = star_graph._table
    lines = [(1, 2, 3), (1, 2, 3), (1, 2, 4), (2, 2, None), (None, 5, 6)]
    frame = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long")
    monkeypatch.setattr(star_graph, "_table", lambda s, d, name: frame if name == "lineitem" else table(s, d, name))
    edges = star_graph.star_edges(spark, DATA).where("type <> 'CONTAINS'")
    assert sorted(((r["type"], r["sourceId"], r["targetId"]) for r in edges.collect()), key=str) == sorted(
        [("IMPORTS", "o1", "p2"), ("CALLS", "o1", "s3"), ("CALLS", "o1", "s4"), ("IMPORTS", "o2", "p2"), ("CALLS", "o2", None), ("IMPORTS", None, "p5"), ("CALLS", None, "s6")], key=str
    )
    assert star_graph.star_edges(spark, DATA)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
