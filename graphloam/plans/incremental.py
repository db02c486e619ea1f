"""A repository's graph that is kept up to date by deltas: an ingestion reads and writes the rows of the files that changed and
of those that import what came or went.

Rows belong to a file and carry the version in which they were written; `changes` says for each file which version of its rows
is alive, so nothing is rewritten in place. What several files derive together is counted: an external node is there while the
sum of its derivations is positive. An index from import target to importing file finds the importers, and an edge's rows say
whether its target exists. Edges and index are stored by a bucket of the file or target, so a delta reads the buckets it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam import schemas
from graphloam.functions import text
from graphloam.operators import chunks as chunking
from graphloam.operators import diff as diffing
from graphloam.operators import extract, graph_build, metrics, vectors
from graphloam.plans.durable import Tables
from graphloam.plans.ingest import reason
from graphloam.plans.versions import Change, Versions

BUCKETS = 64
#: part: what of a file a row of changes is about: `file` (facts, nodes and edges), `edges` alone, or `chunks`.
SCHEMAS = {
    "changes": "path string, part string, v int, contentHash string, alive boolean, inGraph boolean",
    "parsed": f"{schemas.PARSED_FILE}, v int",
    "nodes": f"{schemas.NODES}, v int",
    "edges": f"{schemas.EDGES}, path string, there boolean, v int, bucket int",
    "imports": "targetId string, path string, v int, bucket int",
    "externals": "id string, derivations int, v int",
    "chunks": f"{schemas.CHUNKS}, v int",
}
#: Deltas after which ingest() compacts.
DELTAS = 32


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


class GraphStore:
    """One repository in a folder."""

    def __init__(self, spark: SparkSession, path: str, repository: str) -> None:
        self.spark, self.repository, self.versions = spark, repository, Versions(spark, path, SCHEMAS)

    # ------------------------------------------------------------------------------------------------------ reading

    def _alive(self, number: int, *parts: str) -> DataFrame:
        """(path, v, contentHash, inGraph): the version of each file's rows that is alive."""
        last = self.versions.read("changes", number).where(F.col("part").isin(*parts)).groupBy("path").agg(F.max_by(F.struct("v", "contentHash", "alive", "inGraph"), "v").alias("r"))
        return last.where("r.alive").select("path", "r.v", "r.contentHash", "r.inGraph")

    def _of(self, table: str, number: int, *parts: str, path: str = "path") -> DataFrame:
        rows, alive = self.versions.read(table, number), self._alive(number, *parts).select(F.col("path").alias(path), "v")
        return rows.join(alive, [path, "v"], "left_semi").select(*rows.columns)

    def files(self, number: int | None = None) -> DataFrame:
        """(path, contentHash) of what has been ingested."""
        return self._alive(self._number(number), "file").select("path", "contentHash")

    def parsed(self, number: int | None = None) -> DataFrame:
        return self._of("parsed", self._number(number), "file").drop("v")

    def nodes(self, number: int | None = None) -> DataFrame:
        number = self._number(number)
        own = self._of("nodes", number, "file", path="filePath").drop("v")
        name = F.substring("id", len("external:") + 1, 1 << 30)
        outside = self.versions.read("externals", number).groupBy("id").agg(F.sum("derivations").alias("n")).where("n > 0")
        external = outside.select("id", F.lit("external_dependency").alias("type"), name.alias("label"), F.lit(self.repository).alias("repositoryId"), F.lit("").alias("filePath"), F.to_json(F.struct(name.alias("package"))).alias("metadataJson"))
        root = graph_build.root_node(self._alive(number, "file").agg(F.count_if("inGraph").alias("n")), self.repository)
        return root.unionByName(own).unionByName(external)

    def edges(self, number: int | None = None) -> DataFrame:
        return self._of("edges", self._number(number), "file", "edges").where("there").drop("path", "there", "v", "bucket")

    def chunks(self, number: int | None = None) -> DataFrame:
        return self._of("chunks", self._number(number), "chunks", path="filePath").drop("v")

    def _number(self, number: int | None) -> int:
        return self.versions.latest() if number is None else number

    # ------------------------------------------------------------------------------------------------------ writing

    def ingest(self, files: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, dimension: int = vectors.DIMENSION) -> dict:
        """Files (repositoryId, path, content, contentHash) is what the repository holds now. The row of metrics; what the
        delta wrote is in `written` (rows by table). A failed embedding leaves the chunks as they were, and says so."""
        with Tables(self.spark) as tables:
            return self._ingest(files, embed, dimension, tables)

    def _ingest(self, files: DataFrame, embed, dimension: int, tables: Tables) -> dict:  # noqa: ANN001
        change, watch, written = self.versions.begin(), metrics.Stopwatch(), {}
        base, v = change.base, F.lit(change.number)

        def add(table: str, rows: DataFrame, by: str | None = None) -> None:
            rows = tables.write(rows.withColumn("v", v))
            written[table] = written.get(table, 0) + rows.count()
            if written[table]:
                change.add(table, rows, by)

        before = tables.write(self._alive(base, "file"))
        with watch.stage("diff"):
            supported = files.where(text.is_supported(F.col("path")))
            diff = tables.write(diffing.snapshot_diff(supported.select("path", "contentHash"), before.select("path", "contentHash")))
            todo, stale = diffing.parse_paths(diff), diffing.stale_paths(diff)
        with watch.stage("parse"):
            fresh = tables.write(extract.parse(supported.join(todo, "path", "left_semi")))
            good = fresh.where(extract.has_facts())
        with watch.stage("graph"):
            add("parsed", fresh)
            derived = graph_build.last_wins(graph_build.to_nodes(good), ("repositoryId", "id"))
            add("nodes", derived.where("type <> 'external_dependency'").select(*(c for c in derived.columns if c != "ordinal")))
            # files that come into the graph or leave it: edges of others begin or cease to have a target
            now = good.select("path", F.lit(True).alias("now"))
            was = before.where("inGraph").join(diff.where("bucket <> 'unchanged'"), "path", "left_semi").select("path", F.lit(True).alias("was"))
            turned = tables.write(was.join(now, "path", "full_outer").where("was is null or now is null"))
            importers = tables.write(self._importers(base, turned, diff, tables))
            targets = tables.write(before.where("inGraph").join(diff.where("bucket <> 'unchanged'"), "path", "left_anti").select("path").unionByName(now.select("path")).select(F.concat(F.lit(f"{self.repository}:"), "path").alias("targetId")))
            old = tables.write(self._edges_of(base, stale.unionByName(importers), tables))
            candidates = graph_build.root_edges(good, self.repository, "path").unionByName(graph_build.number_edges(graph_build.to_edges(good), "path"))
            candidates = tables.write(candidates.unionByName(old.join(importers, "path", "left_semi").select(*candidates.columns)))
            add("edges", self._with_target(candidates, targets).withColumn("bucket", _bucket("path")), by="bucket")
            imports = candidates.where("type = 'IMPORTS'")
            add("imports", imports.where(~F.col("targetId").startswith("external:")).join(importers, "path", "left_anti").select("targetId", "path").distinct().withColumn("bucket", _bucket("targetId")), by="bucket")
            add("externals", self._derivations(imports.join(importers, "path", "left_anti"), old.where("type = 'IMPORTS'").join(importers, "path", "left_anti")))
            add("changes", self._changes(diff, good, importers))
        failed = None
        with watch.stage("embed"):
            try:
                new = chunking.chunk(good, files)
                new = tables.write(vectors.embed_chunks(new, embed, dimension) if embed else new)
                add("chunks", new)
                add("changes", diff.where("bucket <> 'unchanged'").select("path", F.lit("chunks").alias("part"), "contentHash", (F.col("bucket") != "deleted").alias("alive"), F.lit(None).cast("boolean").alias("inGraph")))
            except Exception as e:  # noqa: BLE001  without embeddings the repository is still usable
                failed = reason(e)
        self._compact(change)
        number = change.commit()
        counts = metrics.metric_row(diffing.bucket_counts(diff) if base else None, fresh.count())
        return counts | {
            "repositoryId": self.repository, "parseDurationMs": watch.ms["parse"], "graphBuildDurationMs": watch.ms["graph"], "embedDurationMs": watch.ms["embed"], "totalDurationMs": watch.total,
            "errorMessage": failed, "version": number, "written": written,
        }

    def _pruned(self, table: str, number: int, of: DataFrame, tables: Tables) -> DataFrame:
        """A table's rows in the buckets of the column `of` has; a few numbers of buckets come to the driver."""
        buckets = [r[0] for r in of.select(_bucket(of.columns[0])).distinct().collect()]
        return self.versions.read(table, number).where(F.col("bucket").isin(buckets) if buckets else F.lit(False))

    def _importers(self, base: int, turned: DataFrame, diff: DataFrame, tables: Tables) -> DataFrame:
        """Unchanged files that import a file which comes or goes, from the index."""
        ids = tables.write(turned.select(F.concat(F.lit(f"{self.repository}:"), "path").alias("targetId")))
        hit = self._pruned("imports", base, ids, tables).join(ids, "targetId", "left_semi")
        unchanged = self._alive(base, "file").join(diff.where("bucket <> 'unchanged'"), "path", "left_anti")
        return hit.join(unchanged.select("path", "v"), ["path", "v"], "left_semi").select("path").distinct()

    def _edges_of(self, base: int, paths: DataFrame, tables: Tables) -> DataFrame:
        paths = tables.write(paths)
        rows = self._pruned("edges", base, paths, tables).join(paths, "path", "left_semi")
        alive = self._alive(base, "file", "edges").join(paths, "path", "left_semi").select("path", "v")
        return rows.join(alive, ["path", "v"], "left_semi").select(*rows.columns)

    def _with_target(self, edges: DataFrame, targets: DataFrame) -> DataFrame:
        """edges with there: whether the target exists. Only imports of files and parents lead out of an edge's own file."""
        marked = edges.drop("there").join(targets.withColumn("known", F.lit(True)), "targetId", "left")
        outside = F.col("targetId").startswith("external:")
        there = F.when(F.col("type") == "IMPORTS", outside | F.col("known").isNotNull()).otherwise(F.col("type") == "CONTAINS")
        return marked.select(*(c for c in edges.columns if c != "there"), there.alias("there"))

    @staticmethod
    def _derivations(new: DataFrame, old: DataFrame) -> DataFrame:
        """By external node, how many files more (or less) derive it."""
        of = lambda rows, n: rows.where(F.col("targetId").startswith("external:")).select("path", F.col("targetId").alias("id")).distinct().withColumn("n", F.lit(n))
        return of(new, 1).unionByName(of(old, -1)).groupBy("id").agg(F.sum("n").cast("int").alias("derivations")).where("derivations <> 0")

    @staticmethod
    def _changes(diff: DataFrame, good: DataFrame, importers: DataFrame) -> DataFrame:
        own = diff.where("bucket <> 'unchanged'").join(good.select("path", F.lit(True).alias("inGraph")), "path", "left")
        files = own.select("path", F.lit("file").alias("part"), "contentHash", (F.col("bucket") != "deleted").alias("alive"), F.coalesce("inGraph", F.lit(False)).alias("inGraph"))
        return files.unionByName(importers.select("path", F.lit("edges").alias("part"), F.lit(None).cast("string").alias("contentHash"), F.lit(True).alias("alive"), F.lit(None).cast("boolean").alias("inGraph")))

    def _compact(self, change: Change) -> None:
        if len(change.tables.get("changes", [])) > DELTAS:
            change.commit()
            self.compact()
            fresh = self.versions.begin()
            change.base, change.number, change.tables = fresh.base, fresh.number, fresh.tables

    def compact(self) -> None:
        """The rows that are alive in one directory a table, as the next version."""
        change, at = self.versions.begin(), self.versions.latest()
        change.replace("parsed", self._of("parsed", at, "file"))
        change.replace("nodes", self._of("nodes", at, "file", path="filePath"))
        change.replace("edges", self._of("edges", at, "file", "edges"), by="bucket")
        change.replace("imports", self._of("imports", at, "file"), by="bucket")
        change.replace("chunks", self._of("chunks", at, "chunks", path="filePath"))
        change.replace("externals", self.versions.read("externals", at).groupBy("id").agg(F.sum("derivations").cast("int").alias("derivations"), F.max("v").alias("v")).where("derivations > 0"))
        last = self.versions.read("changes", at).groupBy("path", "part").agg(F.max_by(F.struct("v", "contentHash", "alive", "inGraph"), "v").alias("r")).select("path", "part", "r.*")
        change.replace("changes", last.where("alive"))
        change.commit()
        self.versions.vacuum()
