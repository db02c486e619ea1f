"""Anchors from postings against the scan."""

import random
import re

from pyspark.sql import functions as F

from graphloam.operators import retrieval
from graphloam.operators.anchor_index import AnchorIndex
from graphloam.schemas import NODES


def test_postings_equal_the_scan(spark, tmp_path):
    rng = random.Random(4)
    letters = "abAB é🙂\"{"
    word = lambda n: "".join(rng.choices(letters, k=n))
    rows = [(f"n{i:03}", "class", None if i % 17 == 0 else word(rng.randrange(0, 14)), f"r{i % 2}", "", None if i % 5 == 0 else word(rng.randrange(0, 30))) for i in range(250)]
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    index = AnchorIndex(spark, f"file://{tmp_path}/a")
    index.build(nodes.where("id < 'n150'"))
    index.add(nodes.where("id >= 'n150'"))
    words = [["a"], ["ab"], ["aba"], ["é🙂"], ["🙂🙂a"], ["aaaa"], ["abab", "b a"], ["A"], ["zzz"], ['"{'], ["ab", "aaaaaaaaaaaaaaaa"]] + [[word(rng.randrange(1, 6)).lower()] for _ in range(2)]
    for asked in words:
        for repository in (None, "r1") if len(asked[0]) > 2 else (None,):
            want = sorted(r["id"] for r in retrieval.find_anchors(nodes, asked, repository, 1000).collect())
            assert sorted(r["id"] for r in index.matches(asked, repository).collect()) == want, asked
    assert [r["id"] for r in index.find(["aba"]).collect()] == [r["id"] for r in retrieval.find_anchors(nodes, ["aba"]).collect()]
    assert index.find([]).count() == 0 and index.find(["aba"]).columns == nodes.columns


def test_a_search_reads_the_postings_of_its_keywords(spark, tmp_path):
    nodes = spark.range(400).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("file").alias("type"), F.concat(F.lit("label "), F.col("id")).alias("label"), F.lit("r").alias("repositoryId"), F.lit("").alias("filePath"), F.lit('{"path":"a/b"}').alias("metadataJson"))
    index = AnchorIndex(spark, f"file://{tmp_path}/a")
    index.build(nodes)
    plan = index.matches(["label 39"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN|=)", plan)) > 0 and re.search(r"DataFilters: \[[^\]]*gram#\d+ (?:IN|=)", plan) and "metadataJson" not in plan
    assert sorted(r["id"] for r in index.matches(["label 39"]).collect()) == sorted(f"n{i}" for i in [39, *range(390, 400)])
