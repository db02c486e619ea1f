"""What a change reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloam.operators.graph_query import callers_of, nodes_for_files
from graphloam.plans.durable import Tables

# Fixed values.
MAX_IMPACTED, TWO_HOP_BELOW, CONTEXT_IDS, REFERENCES, PR_FILES = 50, 30, 20, 5, 100


def changed_files(pr_files: DataFrame) -> DataFrame:
    """(path) of a pull request's files that are not removed."""
    return pr_files.where(F.col("status") != "removed").select(F.col("filename").alias("path"))


def caller_paths(callers: DataFrame) -> DataFrame:
    """A14."""
    return callers.where(F.col("filePath").isNotNull() & (F.col("filePath") != "")).select(F.col("filePath").alias("path")).distinct()


def impacted_nodes(nodes: DataFrame, edges: DataFrame, paths: DataFrame, repository: str | None = None, below: int = TWO_HOP_BELOW, cap: int | None = MAX_IMPACTED, types: tuple[str, ...] = ("CALLS", "IMPORTS")) -> DataFrame:
    """(hop, nodeId, file, name, relationship): the callers of the paths and, if there are fewer than
    `below`, the callers of the callers' files. A node counts once, with its first hop and, of several relationships there,
    the first by name; the cap is the feature's own. The first hop is written once, as the second one starts from it and is
    planned only if it is small."""
    one = Tables(nodes.sparkSession).write(callers_of(nodes, edges, paths, repository, types))
    two = callers_of(nodes, edges, caller_paths(one), repository, types) if one.limit(below).count() < below else one.limit(0)
    both = one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))
    first = both.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("hop", "relationship"))).where("rn = 1")
    out = first.select("hop", F.col("id").alias("nodeId"), F.col("filePath").alias("file"), F.col("label").alias("name"), "relationship")
    return out.orderBy("hop", "nodeId").limit(cap) if cap is not None else out


def context_ids(direct: DataFrame, impacted: DataFrame, most: int = CONTEXT_IDS) -> DataFrame:
    """(id) of the direct nodes, then of the impacted ones."""
    rows = direct.select(F.lit(0).alias("hop"), "id").unionByName(impacted.select("hop", F.col("nodeId").alias("id")))
    return rows.groupBy("id").agg(F.min("hop").alias("hop")).orderBy("hop", "id").limit(most).select("id")


def query_text(paths: DataFrame, direct: DataFrame) -> DataFrame:
    """one row: all paths and the direct nodes' labels, in order, joined by spaces. It is one text and so one row; a source
    of pull requests gives PR_FILES files at most, so it holds the nodes of that many files."""
    p = paths.agg(F.array_join(F.sort_array(F.collect_list("path")), " ").alias("p"))
    d = direct.agg(F.array_join(F.sort_array(F.collect_list("label")), " ").alias("d"))
    return p.crossJoin(d).select(F.concat_ws(" ", "p", "d").alias("text"))  # one row each


def analyse(nodes: DataFrame, edges: DataFrame, pr_files: DataFrame, repository: str | None = None) -> dict[str, DataFrame]:
    """The tables of a pull request's analysis."""
    paths = changed_files(pr_files)
    direct = nodes_for_files(nodes, paths, repository)
    impacted = impacted_nodes(nodes, edges, paths, repository)
    return {"changed": paths, "direct": direct, "impacted": impacted, "ids": context_ids(direct, impacted), "query": query_text(paths, direct)}
