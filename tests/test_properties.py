"""Invariants over generated inputs, a few hundred a DataFrame."""

import posixpath
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloam.functions import text
from graphloam.operators import diff, extract, graph_query
from graphloam.schemas import EDGES, NODES


def test_normalised_paths(spark):
    rng = random.Random(1)
    paths = ["/".join(rng.choice(["a", "b", ".", "..", ""]) for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    paths = [p for p in paths if not p.startswith("/")]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", text.normalise_path(F.col("p")).alias("n")).collect()
    for r in rows:
        expected = posixpath.normpath(r["p"])
        assert r["n"] == ("" if expected == "." else expected), r["p"]


def test_diff_buckets_partition_the_union(spark):
    rng = random.Random(2)
    side = lambda: [(f"p{i}", rng.choice("abc")) for i in range(300) if rng.random() < 0.7]
    a, b = side(), side()
    rows = diff.snapshot_diff(spark.createDataFrame(a, "path string, contentHash string"), spark.createDataFrame(b, "path string, contentHash string")).collect()
    assert sorted(r["path"] for r in rows) == sorted({p for p, _ in a} | {p for p, _ in b})
    x, y = dict(a), dict(b)
    for r in rows:
        p = r["path"]
        assert r["bucket"] == ("new" if p not in y else "deleted" if p not in x else "unchanged" if x[p] == y[p] else "changed")


def test_shortest_paths_are_symmetric_under_reversal(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(22)}
    nodes = spark.createDataFrame([(str(i), "file", str(i), "r", "", "{}") for i in range(12)], NODES).cache()
    edges = spark.createDataFrame([(f"{a}-{b}", str(a), str(b), "CALLS", None) for a, b in sorted(pairs)], EDGES).cache()
    back = edges.select("id", F.col("targetId").alias("sourceId"), F.col("sourceId").alias("targetId"), "type", "properties").cache()
    near = {a: {b for x, b in pairs if x == a} for a in range(12)}

    def hops(a, b):
        level, seen, n = {a}, {a}, 0
        while level and n < 10:
            n += 1
            level = {y for x in level for y in near[x]} - seen
            if b in level:
                return n
            seen |= level
        return None

    for a, b in ((0, 5), (3, 7)):
        one = graph_query.shortest_path(nodes, edges, str(a), str(b)).agg(F.max("position")).first()[0]
        two = graph_query.shortest_path(nodes, back, str(b), str(a)).agg(F.max("position")).first()[0]
        assert one == two == hops(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab{}()[];'\"`$/*\\\n <>:=,.classfunctionimportexport", max_size=80))
def test_scanners_never_fail(source):
    for language in ("typescript", "java"):
        found = extract.facts(language, source, "p")
        assert set(found) == {"imports", "exports", "classes", "functions"}
