"""The vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloam.operators import vectors
from graphloam.operators.vector_index import VectorIndex, fitted


def clustered(n: int, dimension: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dimension))
    return (centres[rng.integers(0, 40, n)] + 0.35 * rng.normal(size=(n, dimension))).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark):
    x = clustered(4000, 24, 1)
    rows = [(i, f"n{i % 7}", [float(v) for v in r]) for i, r in enumerate(x)]
    nan = float("nan")
    rows += [(9000, "n0", None), (9001, "n0", [0.0] * 24), (9002, "n0", [nan] * 24), (9003, "n0", [1.0] * 8), (9004, "n0", rows[3][2]), (9005, "n0", rows[3][2])]
    return spark.createDataFrame(rows, "id long, nodeId string, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    out = VectorIndex(spark, f"file://{tmp_path_factory.mktemp('index')}")
    out.build(table, node="nodeId", lists=40, dimension=24)
    return out


def pairs(df) -> list:
    return sorted((r["query_id"], r[1], round(r["similarity"], 9)) for r in df.collect())


def test_recall_and_lists_read(spark, table, index):
    queries = table.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    true = pairs(vectors.cosine_topk_many(table, queries))
    notes = index.versions.manifest()["notes"]
    found = index.search(queries)
    assert notes["recall"] >= 0.97 and notes["probes"] <= 10
    assert len(set(pairs(found)) & set(true)) >= 0.95 * len(true)
    one = queries.where("query_id = 100")
    assert index.lists_of(one) == notes["probes"] < 40
    plan = index.search(one)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_exact_search_equals_brute_force(spark, table, index):
    queries = table.where("id % 37 = 0 or (id >= 9000 and id <> 9003)").select(F.col("id").alias("query_id"), "embedding")
    assert pairs(index.search(queries, exact=True, probes=1)) == pairs(vectors.cosine_topk_many(table, queries))
    ids = spark.createDataFrame([("n1",), ("n3",)], "id string")
    assert pairs(index.search(queries, nodes=ids, exact=True, k=5)) == pairs(vectors.cosine_topk_many(table, queries, ids, k=5))


def test_added_rows_and_few_rows(spark, table, tmp_path):
    out = VectorIndex(spark, f"file://{tmp_path}/i")
    out.build(table.limit(0), dimension=24)
    query = table.where("id = 5").select(F.col("id").alias("query_id"), "embedding")
    assert out.search(query).count() == 0
    out.build(table.where("id < 30"), node="nodeId", lists=8, dimension=24)
    out.add(table.where("id >= 30 and id < 300"), node="nodeId")
    assert pairs(out.search(query, exact=True)) == pairs(vectors.cosine_topk_many(table.where("id < 300"), query))
    assert out.versions.read("centroids").agg(F.sum("n")).first()[0] == 300


def test_empty_lists_are_filled_again():
    x = np.repeat(np.eye(3), 50, axis=0)
    assert len(np.unique(fitted(x, 3).argmax(1))) >= 2
