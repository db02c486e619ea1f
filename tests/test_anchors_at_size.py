"""Postings go through shuffles packed; long texts and several repositories end segments."""

from pyspark.sql import functions as F

from graphloam.operators import anchor_index, retrieval
from graphloam.operators.anchor_index import AnchorIndex
from graphloam.schemas import NODES


def test_a_posting_takes_few_bytes(spark, tmp_path):
    key = F.col("id").cast("string")
    nodes = spark.range(20_000).select(F.concat(F.lit("o"), key).alias("id"), F.lit("class").alias("type"), F.concat(F.lit("order "), key).alias("label"), F.lit("r").alias("repositoryId"), F.lit("").alias("filePath"), F.concat(F.lit('{"path":"orders/'), key, F.lit('"}')).alias("metadataJson"))
    nodes.write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    index = AnchorIndex(spark, f"file://{tmp_path}/a")
    index.build(nodes)
    places = nodes.agg(F.sum(F.length("label") + F.length("metadataJson"))).first()[0]
    assert written() - before < 5 * places
    assert index.matches(["er 1999"]).count() == 11


def test_segments_of_several_repositories_and_long_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(anchor_index, "SEGMENT", 7)
    monkeypatch.setattr(anchor_index, "CHARACTERS", 60)
    rows = [(f"n{i:03}", "file", ["", "xyz" * (i % 9), f"l{i}"][i % 3], f"r{i % 4}" if i % 5 else None, "", None if i % 2 else "q" * (i % 70) + f"xyz{i}") for i in range(120)]
    nodes = spark.createDataFrame(rows, NODES)
    index = AnchorIndex(spark, f"file://{tmp_path}/a")
    index.build(nodes)
    for word in ("xyz", "zxyzx", "qqqqqqqqqqq", "q", "xy", "1", "", "l1"):
        assert sorted(r["id"] for r in index.matches([word]).collect()) == sorted(r["id"] for r in retrieval.find_anchors(nodes, [word], None, 1000).collect()), word
