"""Queries do the whole job: whole texts, all of their lines, all query vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloam import queries as core
from graphloam.functions import crypto
from graphloam.operators import vectors
from graphloam.plans import star_graph

LONG = "tökën " * 40_000


@pytest.fixture
def texts(spark, tmp_path):
    rows = [(0, "", "a"), (1, "short", "a"), (2, "x" * 41, "b"), (3, LONG, "b"), (4, "\n1\n\n2\n" + "y" * 5000 + "\n", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), {i: t for i, t, _ in rows}


def test_whole_texts_are_sealed_and_opened(spark, texts, monkeypatch):
    sf_dir, want = texts
    out = core.QUERIES["token_encryption_whole"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["opened"] for r in out} == want and all(r["sealed"] for r in out)
    sealed = crypto.encrypt
    monkeypatch.setattr(crypto, "encrypt", lambda plain, key: sealed(F.substring(plain, 1, 40), key))
    for name in ("token_encryption", "token_encryption_whole"):
        assert {r["doc_id"] for r in core.QUERIES[name](spark, sf_dir).collect() if r["sealed"]} == {0, 1}


def test_every_query_vector_is_searched(spark, tmp_path):
    draw = np.random.default_rng(3)
    e = draw.normal(size=(420, 8)).astype(np.float32)
    e[100:140] = e[50]  # ties, more than k
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(e) if i != 7]
    rows += [(1000, None, 0), (1050, [0.0] * 8, 0), (1100, [1.0, 2.0], 0), (1101, [1.0, 2.5], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(420)], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    x = e.astype(np.float64) / np.linalg.norm(e.astype(np.float64), axis=1)[:, None]
    for name, ids in (("cosine_topk_many", [i for i in range(420) if i != 7]), ("graph_filtered_topk_many", [i for i in range(420) if i % 2 and i != 7])):
        out = core.QUERIES[name](spark, str(tmp_path)).collect()
        want = {(q, i) for q in range(0, 420, 50) for i in sorted(ids, key=lambda i: (-round(float(x[i] @ x[q]), 10), i))[:10]}
        want |= {(1100, 1100), (1100, 1101)} if name == "cosine_topk_many" else set()
        assert {(r["query_id"], r["vec_id"]) for r in out} == want and len(out) == len(want)
    assert core.QUERIES["cosine_topk"](spark, str(tmp_path)).collect() == []
    one = core.QUERIES["cosine_topk_many"](spark, str(tmp_path)).sort("query_id", "similarity", "vec_id").collect()
    data = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    asked = data.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    cut = vectors.cosine_topk_many(data, asked, key="vec_id", block=2).withColumn("similarity", F.round("similarity", 6))
    assert cut.sort("query_id", "similarity", "vec_id").collect() == one


def test_all_lines_of_a_text(spark, texts):
    sf_dir, want = texts
    got: dict = {}
    for r in core.QUERIES["chunk_all_lines"](spark, sf_dir).sort("doc_id", "position").collect():
        got.setdefault(r["doc_id"], []).append(r["line"])
        assert r["position"] == len(got[r["doc_id"]])
    assert {i: "\n".join(lines) for i, lines in got.items()} == want


def test_the_stored_graph_follows_its_tables(spark, tmp_path):
    from pathlib import Path

    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        (tmp_path / f.name).write_bytes(f.read_bytes())
    before = star_graph.stored_graph(spark, str(tmp_path))[0].count()
    assert star_graph.stored_graph(spark, str(tmp_path))[0].count() == before
    regions = spark.read.parquet(str(tmp_path / "region.parquet")).collect()
    (tmp_path / "region.parquet").unlink()
    spark.createDataFrame(regions[:-1], "r_regionkey int, r_name string" if len(regions[0]) == 2 else None).coalesce(1).write.parquet(str(tmp_path / "region.parquet"))
    assert star_graph.stored_graph(spark, str(tmp_path))[0].count() == before - 1
