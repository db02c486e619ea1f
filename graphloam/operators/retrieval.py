"""Keyword anchors and the routing of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloam.functions import text
from graphloam.operators.graph_query import NODE, expand_reverse, expand_undirected, in_repository

# Types of root nodes, and limits.
ROOT_TYPES = ["repository", "file", "module", "service", "controller", "class"]
MAX_ANCHORS, MAX_NODES = 5, 50


def matches_keyword(label: Column, metadata_json: Column, words: Column) -> Column:
    """P5: any keyword in the lower-cased label or metadata (its keys too); the label is not null."""
    low, meta = F.lower(label), F.lower(F.coalesce(metadata_json, F.lit("")))
    return label.isNotNull() & F.exists(words, lambda w: F.contains(low, w) | F.contains(meta, w))


def find_anchors(nodes: DataFrame, words: list[str], repository: str | None = None, limit: int = MAX_ANCHORS) -> DataFrame:
    """P5, L2: the first nodes by id that a keyword matches."""
    keys = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return in_repository(nodes, repository).where(matches_keyword(F.col("label"), F.col("metadataJson"), keys)).orderBy("id").limit(limit)


def root_nodes(nodes: DataFrame, repository: str | None = None, limit: int = MAX_NODES) -> DataFrame:
    """P19."""
    return in_repository(nodes, repository).where(F.col("type").isin(ROOT_TYPES) & F.col("label").isNotNull()).orderBy("id").limit(limit)


def as_retrieved(nodes: DataFrame) -> DataFrame:
    """(id, name, type, filePath)."""
    return nodes.select("id", F.col("label").alias("name"), "type", text.metadata_path(F.col("metadataJson")).alias("filePath"))


def question_facts(spark, question: str) -> tuple[str, list[str]]:  # noqa: ANN001
    """Intent and keywords of one question."""
    row = spark.createDataFrame([(question,)], "q string").select(text.intent(F.col("q")).alias("i"), text.keywords(F.col("q")).alias("k")).first()
    return row["i"], row["k"]


def retrieve(nodes: DataFrame, edges: DataFrame, question: str, repository: str | None = None, intent: str | None = None) -> DataFrame:
    """The nodes to answer a question from. Without keywords or anchors, and for questions about the
    architecture, the root nodes; about dependencies, the anchors and what points at them; else the anchors and two hops."""
    own_intent, words = question_facts(nodes.sparkSession, question)
    intent = intent or own_intent
    anchors = find_anchors(nodes, words, repository) if words else nodes.limit(0)
    if intent == "explain-arch" or not words or not anchors.limit(1).count():
        return as_retrieved(root_nodes(nodes, repository))
    walk = expand_reverse if intent == "explain-deps" else expand_undirected
    return as_retrieved(walk(nodes, edges, anchors, repository).orderBy("hop", "id").limit(MAX_NODES).select(*NODE))
