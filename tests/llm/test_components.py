import random

import pytest
from pyspark.sql import functions as F

from graphloam.llm.common import Durable, join_common
from graphloam.llm.components import FEW, components


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("few", [0, FEW])
def test_components_match_union_find(spark, few):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(500, 560)]
    star = [(900, i) for i in range(901, 980)]
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + chain + star + [(5, 5), (None, 3), (7, 8), (8, 7)]
    keep = Durable(spark)
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), keep, few).collect()}
    assert out == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long"), Durable(spark)).count() == 0


def test_hubs_and_common_keys_are_joined_apart(spark):
    """A node of twelve thousand edges, and a key of as many rows."""
    edges = [(0, i) for i in range(1, 12_001)] + [(20_000 + i, 20_001 + i) for i in range(50)] + [(12_000, 20_000)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Durable(spark), few=0).collect()}
    assert len(out) == 12_052 and set(out.values()) == {0}
    rows = spark.createDataFrame([("hot", i) for i in range(11_000)] + [("a", -1), ("a", -2), ("b", -3)], "k string, v int")
    table = rows.groupBy("k").count().withColumn("m", F.upper("k"))
    joined = join_common(rows, table, ["k"], "count", rows.count())
    assert sorted(map(tuple, joined.select("k", "v", "m").collect())) == sorted((k, v, k.upper()) for k, v in map(tuple, rows.collect()))
