"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloam.llm.common import Durable, join_common

#: Edges that one task may join by union and find, in some tens of megabytes; rounds of joins are for more.
FEW = 1 << 17


class Forest:
    """Union and find over any numbers; the smallest of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, i: int) -> int:
        up = self.up
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(u, v)
    nodes = list(forest.up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(i) for i in nodes], pa.int64())], names=["node", "component"])


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m of their u; least: (u, m, n), a row for each u, n of its edges. Hubs (more than a thousandth of all
    edges; a thousand at most) are joined by a broadcast, so a hub's edges don't meet in one task."""
    return join_common(edges, least, ["u"], "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.where("v > u"), least, 2 * total).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    linked = _with_least(down, least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, keep: Durable, few: int = FEW) -> DataFrame:
    """(node, component) for every node of the edges (u, v): the component's smallest node. Self loops, repeated edges and
    null ends are left out. Up to `few` edges are joined in one task; for more, every round is written to the shared folder and
    takes the place of the one before."""
    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u <> v").distinct()

    def sign(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = keep.keep(tidy(edges.select("u", "v")))
    before = sign(now)
    if before[0] <= few:
        longs = now.select(F.col("u").cast("long"), F.col("v").cast("long"))
        return longs.coalesce(1).mapInArrow(_in_one_task, "node long, component long").select(*(F.col(new).cast(now.schema[old].dataType).alias(new) for new, old in (("node", "u"), ("component", "u"))))
    while before[0]:
        large = keep.keep(tidy(_large_star(now, before[0])))
        new = keep.keep(tidy(_small_star(large, large.count())))
        keep.drop(large)
        keep.drop(now)
        now, after = new, sign(new)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
