"""A path's search shuffles what it reaches and not all edges; edges to what is no node lead nowhere, on either side."""

from pyspark.sql import functions as F

from graphloam.operators import graph_query


def _graph(spark, links: list, names: list):
    edges = spark.createDataFrame([(f"e:{a}:{b}", a, b) for a, b in links], "id string, sourceId string, targetId string")
    return spark.createDataFrame([(n,) for n in names], "id string"), edges


def test_edges_to_no_node_lead_nowhere(spark):
    # a0 is in every position the smaller neighbour, but no node
    nodes, edges = _graph(spark, [("s", "a0"), ("a0", "b1"), ("s", "a1"), ("a1", "b1"), ("b1", "a0"), ("b1", "c1"), ("a1", "b0"), ("b0", "c1"), ("c1", "d0"), ("d0", "t"), ("c1", "d1"), ("d1", "t")], ["a1", "b1", "c1", "d1", "t"])
    got = [r["nodeId"] for r in graph_query.shortest_path(nodes, edges, "s", "t").orderBy("position").collect()]
    assert got == ["s", "a1", "b1", "c1", "d1", "t"]
    assert graph_query.shortest_path(nodes.where("id <> 't'"), edges, "s", "t").count() == 0


def test_a_search_does_not_shuffle_all_edges(spark, tmp_path):
    chain = [("s", "a"), ("a", "b"), ("b", "t")]
    rest = spark.range(60_000).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("x"), F.col("id")).alias("sourceId"), F.concat(F.lit("y"), F.col("id")).alias("targetId"))
    nodes, edges = _graph(spark, chain, ["s", "a", "b", "t"])
    edges.unionByName(rest).write.parquet(f"{tmp_path}/edges")
    nodes.unionByName(rest.select(F.col("targetId").alias("id"))).write.parquet(f"{tmp_path}/nodes")
    edges, nodes = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("edges", "nodes"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of any size are
    try:
        before = written()
        assert graph_query.shortest_path(nodes, edges, "s", "t").count() == 4
        assert written() - before < 200_000  # the edges are more than a megabyte
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
