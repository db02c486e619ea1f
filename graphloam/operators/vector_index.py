"""A stored vector index of inverted lists: rows lie in the list of their nearest centroid, one directory a list, and a search
reads the lists whose centroids are nearest to its queries.

Centroids are fitted on a bounded sample; every row is indexed. How many lists a search reads is measured when the index is
built, by an audit against brute force. Each list keeps its radius (the largest angle to its centroid), so that a search can
also be exact: lists that cannot hold anything better than what was found are left out, all others are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloam.operators.vectors import DIMENSION, QUERY_BLOCK, TOP_K, _best, _nearest
from graphloam.plans.versions import Versions

#: Inverted lists; rows of the sample for each list that centroids are fitted on; rounds of fitting.
LISTS, SAMPLE, ROUNDS = 100, 64, 12
#: Queries of the audit, and the recall of their nearest rows that a search has to reach.
AUDIT, TARGET = 64, 0.97
#: Files that a list's rows are written from at most, so that a list with a third of all rows is not one task's.
SPREAD = 16
SCHEMAS = {"centroids": "list int, centroid array<double>, radius double, n long", "rows": "key long, node string, embedding array<float>, list int"}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids (of length 1) of spherical k-means; rows of the sample have length 1. A centroid that loses all its rows takes
    the row that is farthest from its own."""
    lists = min(lists, len(sample))
    centroids = sample[np.random.default_rng(0).permutation(len(sample))[:lists]]
    for _ in range(rounds):
        near = sample @ centroids.T
        own = near.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero((np.bincount(own, minlength=lists) == 0) | (np.abs(sums).max(1) == 0))
        if len(empty):
            sums[empty] = sample[np.argsort(near.max(1))[: len(empty)]]
        centroids = _unit(sums)
    return centroids


class VectorIndex:
    """An index in a folder; versioned, so that searches see whole builds and additions only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.versions = spark, Versions(spark, path, SCHEMAS)

    def build(self, chunks: DataFrame, key: str = "id", vector: str = "embedding", node: str | None = None, lists: int = LISTS, dimension: int = DIMENSION, k: int = TOP_K, target: float = TARGET) -> None:
        """Indexes every row with a finite vector of `dimension` numbers, not all zero; keys are integers and unique."""
        rows = self._good(chunks, key, vector, node, dimension)
        sample = self._sample(rows, SAMPLE * lists)
        centroids = fitted(sample, lists) if len(sample) else np.zeros((0, dimension))
        change = self.versions.begin()
        change.notes |= {"dimension": dimension, "probes": len(centroids), "recall": None}
        change.tables = {}
        change.add("rows", self._placed(rows, centroids), by="list")
        change.add("centroids", self._measured(self._stored("rows", change.tables), centroids))
        change.commit()
        probes, recall = self._audited(k, target)
        change = self.versions.begin()
        change.notes |= {"probes": probes, "recall": recall}
        change.commit()

    def add(self, chunks: DataFrame, key: str = "id", vector: str = "embedding", node: str | None = None) -> None:
        """More rows, in the lists that there are. Their keys are new."""
        centroids, *_ = self._centroids()
        change = self.versions.begin()
        change.add("rows", self._placed(self._good(chunks, key, vector, node, change.notes["dimension"]), centroids), by="list")
        change.replace("centroids", self._measured(self._stored("rows", change.tables), centroids))
        change.commit()

    def search(self, queries: DataFrame, k: int = TOP_K, nodes: DataFrame | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, key, similarity): the k nearest of the rows in the `probes` lists nearest to each query (query_id,
        embedding); by default as many as the audit asked for. nodes: (id) of the nodes to search in. exact: also in every
        list that may hold a nearer row. Ties go to the smaller key. Queries that are null, zero, not finite or of another
        length have no rows."""
        centroids, radius, numbers = self._centroids()
        notes = self.versions.manifest()["notes"]
        probes = min(probes or notes["probes"], len(centroids))
        rows = self._rows(nodes)
        asked = self._good(queries, "query_id", "embedding", None, notes["dimension"]).select(F.col("key").alias("q"), "embedding")
        out, blocks = None, max(1, -(-asked.count() // QUERY_BLOCK))
        for b in range(blocks):
            got = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").collect()  # QUERY_BLOCK of them, about
            if not got or not probes:
                continue
            ids, vectors = np.array([r["q"] for r in got], np.int64), np.array([r["embedding"] for r in got], np.float64)
            near = _unit(vectors) @ centroids.T
            first = np.zeros(near.shape, bool)
            np.put_along_axis(first, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
            found = self._scan(rows, ids, vectors, first, numbers, k)
            if exact:
                found = self._to_the_end(rows, found, ids, vectors, first, near, radius, numbers, k)
            out = found if out is None else out.unionByName(found)
        return self.spark.createDataFrame([], "query_id long, key long, similarity double") if out is None else out

    def lists_of(self, queries: DataFrame, probes: int | None = None) -> int:
        """How many lists a search for these queries reads."""
        centroids, _, _ = self._centroids()
        vectors = np.array([r["embedding"] for r in queries.select("embedding").collect()], np.float64)
        return len(np.unique(np.argsort(-(_unit(vectors) @ centroids.T), axis=1, kind="stable")[:, : probes or self.versions.manifest()["notes"]["probes"]]))

    # ------------------------------------------------------------------------------------------------------- inside

    @staticmethod
    def _good(rows: DataFrame, key: str, vector: str, node: str | None, dimension: int) -> DataFrame:
        v = F.col(vector)
        finite = v.isNotNull() & (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
        return rows.where(finite).select(F.col(key).cast("long").alias("key"), (F.col(node).cast("string") if node else F.lit(None).cast("string")).alias("node"), v.cast("array<float>").alias("embedding"))

    @staticmethod
    def _sample(rows: DataFrame, n: int) -> np.ndarray:
        """n rows by the hash of their keys, of length 1; each task gives n at most."""
        got = rows.orderBy(F.xxhash64("key"), "key").limit(n).select("embedding").collect()
        return _unit(np.array([r["embedding"] for r in got], np.float64)) if got else np.zeros((0, 0))

    def _placed(self, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        """rows with their list, dealt so that a list's rows come from several tasks."""
        shared = self.spark.sparkContext.broadcast(centroids)  # lists * dimension numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b for b in batches if b.num_rows):
                x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                own = (_unit(x) @ shared.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["key", "node", "embedding", "list"])

        return rows.mapInArrow(run, SCHEMAS["rows"]).repartition(F.col("list"), F.pmod(F.xxhash64("key"), F.lit(SPREAD)))

    def _measured(self, placed: DataFrame, centroids: np.ndarray) -> DataFrame:
        """(list, centroid, radius, n) of rows with their list."""
        shared = self.spark.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least, n = np.ones(len(shared.value)), np.zeros(len(shared.value), np.int64)
            for batch in (b for b in batches if b.num_rows):
                x = _unit(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64))
                own = batch.column(1).to_numpy()
                np.minimum.at(least, own, np.einsum("ij,ij->i", x, shared.value[own]))
                np.add.at(n, own, 1)
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(np.arccos(np.clip(least[has], -1, 1))), pa.array(n[has])], names=["list", "radius", "n"])

        radii = placed.select("embedding", "list").mapInArrow(run, "list int, radius double, n long").groupBy("list").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
        middle = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
        return middle.join(radii, "list", "left").select("list", "centroid", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("n", F.lit(0)).alias("n"))

    def _stored(self, table: str, tables: dict[str, list[str]]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).option("basePath", f"{self.versions.path}/{table}").parquet(*(f"{self.versions.path}/{d}" for d in tables[table]))

    def _rows(self, nodes: DataFrame | None) -> DataFrame:
        rows = self.versions.read("rows")
        return rows if nodes is None else rows.join(nodes.select(F.col("id").cast("string").alias("node")).distinct(), "node", "left_semi")

    def _centroids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroids, radii and numbers of the lists that have rows."""
        got = self.versions.read("centroids").where("n > 0").orderBy("list").collect()
        return np.array([r["centroid"] for r in got], np.float64), np.array([r["radius"] for r in got]), np.array([r["list"] for r in got], np.int64)

    def _scan(self, rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, probed: np.ndarray, numbers: np.ndarray, k: int) -> DataFrame:
        """The k nearest rows of each query in the lists that it probes; other lists' directories are not read."""
        of = {int(numbers[i]): np.flatnonzero(probed[:, i]) for i in np.flatnonzero(probed.any(0)).tolist()}
        shared = self.spark.sparkContext.broadcast((ids, vectors, of))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, of = shared.value
            held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for batch in (b for b in batches if b.num_rows):
                keys, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                for n in np.unique(lists).tolist():
                    at = lists == n
                    q, found, sims = _nearest(keys[at], x[at], vectors[of[n]], k)
                    held = _best(*(np.concatenate(p) for p in zip(held, (of[n][q], found, sims), strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "key", "similarity"])

        best = rows.where(F.col("list").isin(list(of))).select("key", "embedding", "list").mapInArrow(run, "query_id long, key long, similarity double")
        return self._first(best, k)

    @staticmethod
    def _first(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")

    def _to_the_end(self, rows: DataFrame, found: DataFrame, ids: np.ndarray, vectors: np.ndarray, first: np.ndarray, near: np.ndarray, radius: np.ndarray, numbers: np.ndarray, k: int) -> DataFrame:
        """found, and what the other lists hold that is as near: no row of a list is nearer than its centroid's angle less its
        radius."""
        last = {r["query_id"]: r["least"] for r in found.groupBy("query_id").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect()}
        need = np.array([last.get(i, -2.0) for i in ids.tolist()])
        most = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radius[None, :]))
        more = (most >= need[:, None] - 1e-6) & ~first
        return found if not more.any() else self._first(found.unionByName(self._scan(rows, ids, vectors, more, numbers, k)), k)

    def _audited(self, k: int, target: float) -> tuple[int, float | None]:
        """The lists that a search must read, doubled until AUDIT rows find `target` of their k nearest rows; and the recall."""
        rows, (centroids, _, _) = self.versions.read("rows"), self._centroids()
        queries = rows.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(AUDIT).select(F.col("key").alias("query_id"), "embedding").cache()
        try:
            true = {(r["query_id"], r["key"]) for r in self.search(queries, k, probes=len(centroids)).collect()}
            probes = 1
            while True:
                seen = {(r["query_id"], r["key"]) for r in self.search(queries, k, probes=probes).collect()}
                recall = len(seen & true) / len(true) if true else None
                if recall is None or recall >= target or probes >= len(centroids):
                    return max(1, min(probes, len(centroids))), recall
                probes *= 2
        finally:
            queries.unpersist()
