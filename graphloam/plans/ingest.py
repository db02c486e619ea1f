"""Ingestion of one repository: scan, diff, parse, graph, chunks, embeddings; incremental by file."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam import schemas
from graphloam.operators import chunks as chunking
from graphloam.operators import diff as diffing
from graphloam.operators import extract, graph_build, metrics, mutate, vectors
from graphloam.plans.durable import Tables
from graphloam.plans.versions import Versions

TABLES = {"parsed": schemas.PARSED_FILE, "nodes": schemas.NODES, "edges": schemas.EDGES, "chunks": schemas.CHUNKS}
LOG = "jobId string, step int, stage string, percent int"

# The share of a job that is done when a stage begins.
PROGRESS = {"cloning": 5, "diffing": 15, "parsing": 25, "building_graph": 60, "indexing": 80}


class IngestionError(RuntimeError):
    """code says which part failed."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def reason(e: Exception) -> str:
    """What went wrong, in a line: of an exception in a worker, its own message."""
    own = re.findall(r"(?m)^\s*(?:[\w.]+\.)?\w*(?:Error|Exception): (.+)$", str(e)) if "Traceback" in str(e) else []
    return (own[-1] if own else str(e)).strip()[:300]


@dataclass
class State:
    """The tables of a workspace; every ingestion gives a new state."""

    parsed: DataFrame
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame


class Workspace:
    """The tables of all repositories in a folder, each repository in a directory and with versions of its own: an ingestion
    reads and replaces its repository's rows only, and its four tables change together."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def versions(self, repository: str) -> Versions:
        return Versions(self.spark, f"{self.path}/repository={quote(repository, safe='')}", TABLES)

    def state(self, repository: str) -> State:
        """A repository's tables, all of one version; empty ones if it is new."""
        at = self.versions(repository)
        number = at.latest()
        return State(**{t: at.read(t, number) for t in TABLES})

    def whole(self, table: str) -> DataFrame:
        """A table's rows of all repositories."""
        out = self.spark.createDataFrame([], TABLES[table])
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [unquote(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(root)] if fs.exists(root) else []
        found = [f"{at.path}/{d}" for at in map(self.versions, names) for d in at.manifest()["tables"].get(table, [])]
        return self.spark.read.schema(TABLES[table]).parquet(*found) if found else out

    def put(self, repository: str, state: State) -> None:
        """state in the place of what the repository had: written first, then made the next version by one rename."""
        at = self.versions(repository)
        change = at.begin()
        for t in TABLES:
            change.replace(t, getattr(state, t))
        change.commit()
        at.vacuum()

    def ingest(self, files: DataFrame, repository: str, **options) -> dict:  # noqa: ANN003
        """ingest() on the stored state; the new one takes its place. The row of metrics."""
        with Tables(self.spark) as tables:
            new, row = ingest(self.state(repository), files, repository, tables=tables, **options)
            self.put(repository, new)
        return row


class JobLog:
    """A table of the stages that a job has reached; an instance is a `progress` callback."""

    def __init__(self, spark: SparkSession, path: str, job: str) -> None:
        self.spark, self.path, self.job, self.step = spark, path, job, 0

    def __call__(self, stage: str, percent: int) -> None:
        self.step += 1
        self.spark.createDataFrame([(self.job, self.step, stage, percent)], LOG).write.mode("append").parquet(self.path)

    @staticmethod
    def latest(spark: SparkSession, path: str) -> DataFrame:
        """The last stage of each job."""
        return mutate.latest_by_key(spark.read.schema(LOG).parquet(path), "jobId", "step")


def acquire(url: str, target: str, branch: str | None = None) -> dict[str, str]:
    """A shallow clone, or of an existing one a fetch and hard reset to the remote branch. Runs on the driver, outside
    any plan; a local directory does as a url."""
    def git(*args: str) -> str:
        done = subprocess.run(["git", *args], capture_output=True, text=True, check=False)
        if done.returncode:
            raise IngestionError("INGESTION", done.stderr.strip()[:300])
        return done.stdout.strip()

    if (Path(target) / ".git").exists():
        name = branch or git("-C", target, "rev-parse", "--abbrev-ref", "HEAD")
        git("-C", target, "fetch", "--depth", "1", "origin", name)
        git("-C", target, "reset", "--hard", f"origin/{name}" if not branch else "FETCH_HEAD")
    else:
        git("clone", "--depth", "1", *(["--branch", branch] if branch else []), url, target)
    return {"localPath": target, "commitHash": git("-C", target, "rev-parse", "HEAD"), "defaultBranch": git("-C", target, "rev-parse", "--abbrev-ref", "HEAD")}


def empty_state(spark: SparkSession) -> State:
    return State(**{t: spark.createDataFrame([], s) for t, s in TABLES.items()})


def ingest(state: State, files: DataFrame, repository: str, embed: Callable[[list[str]], list[list[float]]] | None = None, dimension: int = vectors.DIMENSION, progress: Callable[[str, int], None] = lambda *_: None, tables: Tables | None = None) -> tuple[State, dict]:
    """The state after files (FILES) is what the repository holds, and the row of metrics.

    Only changed and new files are parsed, chunked and embedded; facts of changed and deleted files go first. Edges are derived
    from the stored facts of all files, as an unchanged file may import what is new, or what is gone. Embedding fails
    or succeeds as a whole: on a failure the graph is new, the chunks stay as they were, and the metric row says why.
    """
    tables, watch = tables or Tables(files.sparkSession), metrics.Stopwatch()
    own = F.col("repositoryId") == repository
    known = state.parsed.where(own).select("path", "contentHash")
    again = bool(known.limit(1).count())
    with watch.stage("diff"):
        progress("diffing", PROGRESS["diffing"])
        supported = files.where(extract.text.is_supported(F.col("path")))
        diff = tables.write(diffing.snapshot_diff(supported.select("path", "contentHash"), known))
        todo = supported.join(diffing.parse_paths(diff), "path", "left_semi")
        stale = diffing.stale_paths(diff)
    with watch.stage("parse"):
        progress("parsing", PROGRESS["parsing"])
        fresh = tables.write(extract.parse(todo))
    with watch.stage("graph"):
        progress("building_graph", PROGRESS["building_graph"])
        kept_nodes, kept_edges = mutate.delete_for_files(state.nodes, state.edges, stale, repository, prune_externals=False)
        parsed = tables.write(mutate.delete_by_keys(state.parsed, stale.withColumn("repositoryId", F.lit(repository)))[0].unionByName(fresh))
        built, _, _ = graph_build.build_graph(fresh, repository)
        whole, edges_all, _ = graph_build.build_graph(parsed.where(own), repository)
        nodes = mutate.merge_nodes(mutate.merge_nodes(kept_nodes, built), whole.where(F.col("type") == "repository"))
        other = kept_edges.join(nodes.where(~own).select(F.col("id").alias("sourceId")), "sourceId", "left_semi").select(*kept_edges.columns)
        edges = tables.write(mutate.merge_edges(other, edges_all, nodes))
        used = edges.select(F.col("targetId").alias("id")).distinct()
        orphan = (F.col("type") == "external_dependency") & own
        nodes = tables.write(nodes.where(~orphan).unionByName(nodes.where(orphan).join(used, "id", "left_semi").select(*nodes.columns)))
    chunks, failed = state.chunks, None
    with watch.stage("embed"):
        progress("indexing", PROGRESS["indexing"])
        new = chunking.chunk(fresh.where(extract.has_facts()), files)
        try:
            new = tables.write(vectors.embed_chunks(new, embed, dimension) if embed else new)
            gone = stale.select(F.lit(repository).alias("repositoryId"), F.col("path").alias("filePath"))
            chunks = tables.write(mutate.delete_by_keys(state.chunks, gone)[0].unionByName(new))
        except Exception as e:  # noqa: BLE001  without embeddings the repository is still usable
            failed = reason(e)
    counts = metrics.metric_row(diffing.bucket_counts(diff) if again else None, fresh.count())
    row = counts | {
        "repositoryId": repository, "parseDurationMs": watch.ms["parse"], "graphBuildDurationMs": watch.ms["graph"], "embedDurationMs": watch.ms["embed"], "totalDurationMs": watch.total,
        "nodeCount": nodes.where(own).count(), "edgeCount": edges.join(nodes.where(own).select(F.col("id").alias("sourceId")), "sourceId", "left_semi").count(), "chunkCount": chunks.where(own).count(), "errorMessage": failed,
    }
    return State(parsed, nodes, edges, chunks), row
