"""Queries of the service's side: webhooks, jobs, repositories, questions, analyses, writes and scalar functions."""

from __future__ import annotations

import hashlib
import hmac
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.functions import crypto, text
from graphloam.operators import diff, graph_query, impact, metrics, mutate, retrieval, vectors, workspace
from graphloam.plans import copilot, ingest, pr_analysis
from graphloam.plans.durable import Tables
from graphloam.plans.rendered import SOURCES_SQL, sources
from graphloam.plans.star_graph import stored_graph
from graphloam.queries import _BOTH_SQL, _DIFF, _NODE_SQL, BRAND, _read, _rows, _snapshots, query
from graphloam.queries_code import measured
from graphloam.schemas import ANALYSES, CHUNKS, DELIVERIES, JOBS, MESSAGES, WEBHOOK_EVENTS
from graphloam.streaming import jobs, webhooks

# ------------------------------------------------------------------------------------------------------------- webhooks

SECRETS = {"r0": "s-zero", "r1": "s-one", "r2": "s-two", "r3": "s-three"}


def _body(ref: str, after: str) -> str:
    return f'{{"ref":"refs/heads/{ref}","after":"{after}"}}'


def _signatures() -> Column:
    """What another implementation signs: the standard library's, for each secret and body."""
    known = {f"{r}|{ref}|{k}": hmac.new(s.encode(), _body(ref, str(k)).encode(), hashlib.sha256).hexdigest() for r, s in SECRETS.items() for ref in ("main", "dev") for k in range(10)}
    return F.create_map(*(F.lit(x) for kv in known.items() for x in kv))


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushes and other events to seven repositories, some unsigned, badly signed, without an id or delivered before."""
    e, k, i = _read(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("int") % 10, F.col("event_id")
    ref = F.when(F.get_json_object("props", "$.k").cast("int") % 4 < 3, "main").otherwise("dev")
    repo = F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string"))
    body = F.concat(F.lit('{"ref":"refs/heads/'), ref, F.lit('","after":"'), k.cast("string"), F.lit('"}'))
    good = F.element_at(_signatures(), F.concat_ws("|", repo, ref, k.cast("string")))
    signature = F.when(i % 17 == 0, F.concat(F.lit("sha256="), F.repeat(F.lit("0"), F.lit(64)))).when(i % 19 == 0, good).otherwise(F.concat(F.lit("sha256="), good))
    event = F.when(F.col("event_type") == "view", "ping").when(F.col("event_type") == "signup", "issues").otherwise("push")
    delivery = F.when(i % 11 == 0, F.lit(None).cast("string")).when(i % 23 == 0, "").otherwise(F.concat(F.lit("d"), i.cast("string")))
    return e.select(i.alias("event_id"), repo.alias("repositoryId"), body.cast("binary").alias("rawBody"), delivery.alias("deliveryId"), event.alias("event"), signature.alias("signature"), F.col("ts").cast("timestamp").alias("receivedAt"))


def _repositories(spark: SparkSession) -> DataFrame:
    rows = [("r0", SECRETS["r0"], None, None, "0"), ("r1", SECRETS["r1"], "dev", "main", "1"), ("r2", SECRETS["r2"], None, "trunk", None), ("r3", SECRETS["r3"], None, "main", "3"), ("r4", None, None, None, None)]
    return spark.createDataFrame(rows, "id string, webhookSecret string, trackedBranch string, defaultBranch string, currentCommitHash string")


_GATES_SQL = """WITH e AS (SELECT event_id, 'r' || (user_id % 7) AS repo, (json_extract(props, '$.k'))::INTEGER AS k0, event_type FROM events),
d AS (SELECT *, k0 % 10 AS k, CASE WHEN k0 % 4 < 3 THEN 'main' ELSE 'dev' END AS ref FROM e),
o AS (SELECT *, CASE WHEN event_id % 11 = 0 OR event_id % 23 = 0 THEN 'missing_delivery' WHEN event_id % 13 = 0 THEN 'duplicate' WHEN repo IN ('r5', 'r6') THEN 'unknown_repository' WHEN repo = 'r4' THEN 'unconfigured'
  WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN 'bad_signature' END AS gate,
  CASE WHEN event_type = 'view' THEN 'ping' WHEN event_type = 'signup' THEN 'not a push' WHEN ref <> CASE repo WHEN 'r1' THEN 'dev' WHEN 'r2' THEN 'trunk' ELSE 'main' END THEN 'other branch'
    WHEN (repo, k) IN (('r0', 0), ('r1', 1), ('r3', 3)) THEN 'same commit' END AS skip FROM d)"""


@query(
    _GATES_SQL
    + """ SELECT event_id, coalesce(gate, CASE WHEN skip IS NULL THEN 'accepted' ELSE 'skipped' END) AS outcome, CASE WHEN gate IS NULL THEN CASE WHEN skip IS NULL THEN 'ACCEPTED' ELSE 'SKIPPED' END END AS status,
  CASE WHEN gate IS NULL THEN skip END AS "errorMessage" FROM o"""
)
def webhook_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each delivery."""
    audit = _read(spark, sf_dir, "events").where("event_id % 13 = 0").select(F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("deliveryId"))
    return webhooks.route(_deliveries(spark, sf_dir), _repositories(spark), audit).select("event_id", "outcome", "status", "errorMessage")


@query(
    _GATES_SQL.replace("WHEN event_id % 13 = 0 THEN 'duplicate' ", "")
    + """ SELECT 'd' || event_id AS "deliveryId", repo AS "repositoryId", CASE WHEN skip IS NULL THEN 'ACCEPTED' ELSE 'SKIPPED' END AS status, skip AS "errorMessage",
  sha256('{"ref":"refs/heads/' || ref || '","after":"' || k || '"}') AS "payloadHash", skip IS NULL AS job FROM o WHERE gate IS NULL"""
)
def webhook_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries as a stream, a third of them twice in one batch and another third again in a later one; the
    audit and job tables hold each once."""
    base = Tables(spark).folder()
    d = _deliveries(spark, sf_dir).where("coalesce(deliveryId, '') <> ''")
    d.unionByName(d.where("event_id % 3 = 0")).drop("event_id").write.parquet(f"{base}/in/one")
    for again in (False, True):
        if again:
            d.where("event_id % 3 = 1").drop("event_id").write.parquet(f"{base}/in/two")
        stream = spark.readStream.schema(DELIVERIES).option("recursiveFileLookup", True).parquet(f"{base}/in")
        webhooks.start(stream, _repositories(spark), f"{base}/audit", f"{base}/jobs", f"{base}/checkpoint").awaitTermination()
    audit = spark.read.schema(WEBHOOK_EVENTS).option("recursiveFileLookup", True).parquet(f"{base}/audit")
    made = spark.read.schema(JOBS).option("recursiveFileLookup", True).parquet(f"{base}/jobs").select(F.col("webhookEventId").alias("id"), F.lit(True).alias("made"))
    return audit.join(made, "id", "left").select("deliveryId", "repositoryId", "status", "errorMessage", "payloadHash", F.coalesce("made", F.lit(False)).alias("job"))


@query("SELECT 'j' || n_nationkey AS \"jobId\", CASE n_nationkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS attempts, CASE WHEN n_nationkey % 5 IN (0, 2) THEN 'FAILED' ELSE 'DONE' END AS status FROM nation")
def job_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that succeed at once, at the second attempt, never, or are not worth another one; run twice over the same
    queue, which runs none again."""
    base, attempts = Tables(spark).folder(), {}
    n = F.col("n_nationkey")
    rows = _read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), n.cast("string")).alias("repositoryId"), F.concat(F.lit("j"), n.cast("string")).alias("jobId"), F.lit("manual").alias("triggeredBy"), F.lit(None).cast("string").alias("webhookEventId"))
    rows.repartition(3).write.parquet(f"{base}/jobs")

    def work(job: dict) -> None:
        k = int(job["jobId"][1:])
        attempts[job["jobId"]] = attempts.get(job["jobId"], 0) + 1
        if k % 5 == 0:
            raise jobs.Unrecoverable
        if k % 5 == 2 or (k % 5 == 1 and attempts[job["jobId"]] == 1):
            raise RuntimeError

    for run in ("one", "two"):  # the second worker has a checkpoint of its own, and only the table of finished jobs to go by
        jobs.start_worker(jobs.job_stream(spark, f"{base}/jobs"), work, f"{base}/{run}", done=f"{base}/done", pause_ms=0).awaitTermination()
    told = spark.createDataFrame(list(attempts.items()), "jobId string, attempts int")
    return spark.read.schema(jobs.DONE).parquet(f"{base}/done").join(told, "jobId")


@query(
    """SELECT 'j' || o_orderkey AS "jobId", CASE o_orderkey % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS attempts, CASE WHEN o_orderkey % 5 IN (0, 2) THEN 'FAILED' ELSE 'DONE' END AS status,
  CASE WHEN o_orderkey % 5 NOT IN (0, 2) THEN 'r' || o_custkey END AS result, CASE o_orderkey % 5 WHEN 0 THEN 'Unrecoverable: never' WHEN 2 THEN 'RuntimeError: not yet' END AS error FROM orders"""
)
def job_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for every order, on the executors: those that succeed at once, at the second attempt, never, or are not
    worth another one; two pools over one queue, of which the second has nothing left to do."""
    work = Tables(spark)
    base, o = work.folder(), _read(spark, sf_dir, "orders")
    text_of = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    o.select(text_of("r", "o_custkey").alias("repositoryId"), text_of("j", "o_orderkey").alias("jobId"), F.lit("manual").alias("triggeredBy"), F.lit(None).cast("string").alias("webhookEventId")).repartition(4).write.parquet(f"{base}/jobs")

    def run(job: dict, attempt: int) -> str:
        k = int(job["jobId"][1:]) % 5
        if k == 0:
            raise jobs.Unrecoverable("never")
        if k == 2 or (k == 1 and attempt == 1):
            raise RuntimeError("not yet")
        return job["repositoryId"]

    for pool in ("one", "two"):
        query = jobs.start_pool(jobs.job_stream(spark, f"{base}/jobs", 2), run, f"{base}/{pool}", f"{base}/done", pause_ms=0)
        query.awaitTermination()
        assert not jobs.progress(query)["active"]
    return spark.read.schema(jobs.RESULT).parquet(f"{base}/done").select("jobId", "attempts", "status", "result", "error")


# --------------------------------------------------------------------------------------------------------- repositories


def _workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    at = F.timestamp_seconds(k % 50)
    null = F.lit(None)
    return _read(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "READY").otherwise("PARSING").alias("status"), F.lit("GITHUB").alias("sourceType"),
        F.when(k % 3 == 0, null).otherwise(F.concat(F.lit("w"), k.cast("string"))).cast("string").alias("webhookSecret"), F.concat(F.lit("t"), k.cast("string")).alias("githubToken"),
        F.when(k % 4 == 0, at).alias("lastWebhookAt"), F.when(k % 8 != 0, "ACCEPTED").alias("lastWebhookStatus"), F.when(k % 5 == 0, at).alias("deletedAt"), at.alias("createdAt"),
    )


@query("SELECT 'c' || c_custkey AS id, (c_custkey % 50)::BIGINT AS created FROM customer WHERE c_custkey % 5 <> 0 ORDER BY c_custkey % 50 DESC, 'c' || c_custkey LIMIT 20")
def live_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of those that are not deleted."""
    return workspace.live_repositories(_workspace(spark, sf_dir)).limit(20).select("id", F.unix_timestamp("createdAt").alias("created"))


@query(
    """SELECT 'c' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'ready' ELSE 'parsing' END AS status, 'github' AS "sourceType", c_custkey % 3 <> 0 AS "webhookConfigured",
  CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 'accepted' END AS sync, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN (c_custkey % 50)::BIGINT END AS synced, false AS leaks FROM customer"""
)
def public_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a repository; no secret column is left."""
    out = workspace.public_view(_workspace(spark, sf_dir))
    leaks = F.lit(bool(set(workspace.SECRETS) & set(out.columns)))
    return out.select("id", "name", "status", "sourceType", "webhookConfigured", F.col("syncStatus.status").alias("sync"), F.unix_timestamp("syncStatus.at").alias("synced"), leaks.alias("leaks"))


@query("SELECT 'c7' AS id, 't7' AS \"githubToken\", 'w7' AS \"webhookSecret\" UNION ALL SELECT 'c8', 't8', 'w8'")
def repository_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one read of secrets, and a point lookup."""
    rows = _workspace(spark, sf_dir)
    return workspace.secrets(rows, "c7").unionByName(workspace.by_key(rows, id="c8", sourceType="GITHUB").select("id", *workspace.SECRETS))


@query(SOURCES_SQL + """ SELECT path, sha256(content) AS "contentHash" FROM src WHERE repo = 'r2'""")
def file_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21, S23."""
    return workspace.registry(sources(spark, sf_dir), "r2")


@query("SELECT s_suppkey, 'local-workspace' AS \"workspaceId\", 'Local workspace' AS workspace, 'local-user' AS \"userId\", 'Local user' AS \"user\" FROM supplier")
def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repository belongs to the seeded workspace, and that to the seeded user."""
    w, u = workspace.seed(spark)
    repositories = _read(spark, sf_dir, "supplier").select("s_suppkey", F.lit("local-workspace").alias("workspaceId"))
    owned = repositories.join(F.broadcast(w.select(F.col("id").alias("workspaceId"), F.col("name").alias("workspace"))), "workspaceId")
    users = u.select("workspaceId", F.col("id").alias("userId"), F.col("name").alias("user"))
    return owned.join(F.broadcast(users), "workspaceId").select("s_suppkey", "workspaceId", "workspace", "userId", "user")  # one row each


# -------------------------------------------------------------------------------------------------------------- writes


@query("SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'renamed' ELSE s_name END AS s_name, s_suppkey = 4 AS deleted FROM supplier")
def updated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M5."""
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_suppkey").cast("string").alias("id"), F.lit(None).cast("timestamp").alias("deletedAt"))
    out = mutate.soft_delete(mutate.update_by_key(s, "s_suppkey", 3, s_name="renamed"), "4")
    return out.select("s_suppkey", "s_name", F.col("deletedAt").isNotNull().alias("deleted"))


@query("SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'own' || n_nationkey ELSE sha256(n_name || '|' || n_regionkey) END AS id, 2::BIGINT AS n FROM nation")
def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, F32: rows appended twice; what has an id keeps it, the others get the same one each time."""
    path = Tables(spark).folder()
    n = _read(spark, sf_dir, "nation")
    rows = n.select("n_name", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("own"), F.col("n_nationkey").cast("string"))).alias("id"))
    for _ in range(2):
        mutate.insert(rows, path, ["n_name", "n_regionkey"])
    return spark.read.parquet(path).groupBy("n_name", "id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, upper(n_name) || '!' AS n_name FROM nation")
def swapped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: a table that is replaced while it is read."""
    path = Tables(spark).folder()
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    mutate.swap_in(spark, n, path)
    mutate.swap_in(spark, spark.read.parquet(path).withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))), path)
    return spark.read.parquet(path)


@query(
    """ SELECT id, "sourceId", "targetId", type FROM edges WHERE type = 'CONTAINS' UNION ALL SELECT DISTINCT id || '+', "sourceId", "targetId", type FROM edges WHERE type = 'CONTAINS' AND left("sourceId", 1) = 'r'""",
    graph=True,
)
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are there already, that repeat, and that dangle add nothing."""
    nodes, edges = stored_graph(spark, sf_dir)
    old = edges.where("type = 'CONTAINS'")
    fresh = old.where("sourceId like 'r%'").withColumn("id", F.concat("id", F.lit("+")))
    return mutate.merge_edges(old, old.unionByName(fresh).unionByName(fresh).unionByName(old.withColumn("targetId", F.concat("targetId", F.lit("?")))), nodes)


@query(f"SELECT path, bucket <> 'new' AS stale, bucket <> 'deleted' AS parse FROM ({_DIFF}) WHERE bucket <> 'unchanged'")
def paths_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: what goes and what is parsed."""
    d = diff.snapshot_diff(*_snapshots(spark, sf_dir))
    stale, parse = diff.stale_paths(d).withColumn("s", F.lit(True)), diff.parse_paths(d).withColumn("p", F.lit(True))
    return stale.join(parse, "path", "full_outer").select("path", F.coalesce("s", F.lit(False)).alias("stale"), F.coalesce("p", F.lit(False)).alias("parse"))


# ------------------------------------------------------------------------------------------------------------- ingestion

@query(
    SOURCES_SQL
    + """, one AS (SELECT * FROM src WHERE repo = 'r1'), n AS (SELECT count(*) AS files, count(*) FILTER (k % 3 = 1 AND kind <> 4) AS changed, count(*) FILTER (k % 3 = 2 AND kind <> 4) AS gone FROM one)
SELECT 'first' AS run, files::BIGINT AS "newFiles", 0::BIGINT AS "changedFiles", 0::BIGINT AS "deletedFiles", 0::BIGINT AS "unchangedFiles", true AS timed, NULL AS error, 'indexing' AS stage, 80 AS percent FROM n
UNION ALL SELECT 'second', 1, changed, gone, files - changed - gone, true, NULL, 'indexing', 80 FROM n
UNION ALL SELECT 'third', 0, 1, 0, files - gone, true, 'EMBEDDING: no model', 'indexing', 80 FROM n"""
)
def ingested_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository ingested into a stored workspace, again after files changed, went and came, and once more
    without a model; with the durations of each job in order, its failure, and its last stage from the log."""

    def no_model(texts: list[str]) -> list[list[float]]:
        raise ingest.IngestionError("EMBEDDING", "no model")

    base = Tables(spark).folder()
    place = ingest.Workspace(spark, f"{base}/workspace")
    files = sources(spark, sf_dir).where("repositoryId = 'r1'")
    k = F.regexp_extract("path", "(?i)part([0-9]+)", 1)
    number = F.when(k != "", k.cast("long"))
    later = files.where(number.isNull() | (number % 3 != 2)).withColumn("content", F.when(number % 3 == 1, F.concat("content", F.lit("\n"))).otherwise(F.col("content"))).withColumn("contentHash", text.content_hash(F.col("content")))
    more = spark.createDataFrame([("r1", "src/more.py", "def more():\n    pass\n")], "repositoryId string, path string, content string").withColumn("contentHash", text.content_hash(F.col("content")))
    out = None
    last = later.unionByName(more.withColumn("content", F.lit("x = 1\n")).withColumn("contentHash", text.content_hash(F.lit("x = 1\n"))))
    for run, now, embed in (("first", files, measured), ("second", later.unionByName(more), measured), ("third", last, no_model)):
        row = place.ingest(now, "r1", embed=embed, dimension=3, progress=ingest.JobLog(spark, f"{base}/log", run))
        took = [row[f"{stage}DurationMs"] for stage in ("parse", "graphBuild", "embed")]
        timed = min(took) > 0 and sum(took) <= row["totalDurationMs"]
        one = spark.createDataFrame([(run, *(row[f"{b}Files"] for b in ("new", "changed", "deleted", "unchanged")), timed, row["errorMessage"])], "run string, newFiles long, changedFiles long, deletedFiles long, unchangedFiles long, timed boolean, error string")
        out = one if out is None else out.unionByName(one)
    log = ingest.JobLog.latest(spark, f"{base}/log").select(F.col("jobId").alias("run"), "stage", "percent")
    return out.join(log, "run")


@query(
    f"""SELECT 'first' AS run, count(*) FILTER (bucket <> 'deleted')::INTEGER AS new, 0 AS changed, 0 AS deleted, 0 AS unchanged FROM ({_DIFF})
UNION ALL SELECT 'later', {", ".join(f"count(*) FILTER (bucket = '{b}')::INTEGER" for b in ("new", "changed", "deleted", "unchanged"))} FROM ({_DIFF})"""
)
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a diff all parsed files are new."""
    disk, registry = _snapshots(spark, sf_dir)
    counts = diff.bucket_counts(diff.snapshot_diff(disk, registry))
    rows = [(run, *(m[f"{b}Files"] for b in ("new", "changed", "deleted", "unchanged"))) for run, m in (("first", metrics.metric_row(None, disk.count())), ("later", metrics.metric_row(counts, 0)))]
    return spark.createDataFrame(rows, "run string, new int, changed int, deleted int, unchanged int")


# ------------------------------------------------------------------------------------------------------------- questions

_FOUND = """(label IS NOT NULL AND (contains(lower(label), '{0}') OR contains(lower("metadataJson"), '{0}')))"""
_SHOW = 'id, label AS name, type, "filePath"'


@query(
    f"""{_BOTH_SQL}, n0 AS (SELECT * FROM nodes WHERE "repositoryId" = 'r1'),
a1 AS (SELECT id FROM n0 WHERE {_FOUND.format("imports")} OR {_FOUND.format("machinery")} ORDER BY id LIMIT 5),
h1 AS (SELECT id, 0 AS hop FROM a1 UNION ALL SELECT "sourceId", 1 FROM edges WHERE "targetId" IN (SELECT id FROM a1)),
m1 AS (SELECT id, min(hop) AS hop FROM h1 GROUP BY id),
a2 AS (SELECT id FROM n0 WHERE {_FOUND.format("find")} OR {_FOUND.format("suppliers")} ORDER BY id LIMIT 5),
h2 AS (SELECT id, 0 AS hop FROM a2 UNION ALL SELECT b, 1 FROM both_ways WHERE a IN (SELECT id FROM a2)
  UNION ALL SELECT y.b, 2 FROM both_ways y WHERE y.a IN (SELECT b FROM both_ways WHERE a IN (SELECT id FROM a2))),
m2 AS (SELECT id, min(hop) AS hop FROM h2 GROUP BY id),
roots AS (SELECT {_SHOW} FROM n0 WHERE type IN ('repository', 'file', 'module', 'service', 'controller', 'class') AND label IS NOT NULL ORDER BY id LIMIT 50)
SELECT 'deps' AS question, * FROM (SELECT {_SHOW} FROM m1 JOIN n0 USING (id) ORDER BY hop, id LIMIT 50)
UNION ALL SELECT 'logic', * FROM (SELECT {_SHOW} FROM m2 JOIN n0 USING (id) ORDER BY hop, id LIMIT 50)
UNION ALL SELECT 'overview', * FROM roots UNION ALL SELECT 'nothing', * FROM roots UNION ALL SELECT 'unknown', * FROM roots""",
    graph=True,
)
def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """retrieve() as it is called, with each intent and both fallbacks."""
    nodes, edges = stored_graph(spark, sf_dir)
    asked = {"deps": "What imports machinery?", "logic": "find all suppliers", "overview": "Explain the suppliers", "nothing": "what is it?", "unknown": "trace the zzyzx"}
    out = None
    for name, question in asked.items():
        found = retrieval.retrieve(nodes, edges, question, "r1").select(F.lit(name).alias("question"), "id", "name", "type", "filePath")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    """, n8 AS (SELECT * FROM nodes WHERE type = 'module'), p AS (SELECT string_agg('[' || upper(type) || '] ' || label || ' → ' || "filePath", chr(10) ORDER BY id) AS t FROM (SELECT * FROM n8 ORDER BY id LIMIT 30)),
c AS (SELECT string_agg(b || ':1-2 (' || b || ')' || chr(10) || t, chr(10) || chr(10) ORDER BY s DESC, b) AS t FROM (SELECT 'd' || doc_id AS b, coalesce(text, '') AS t, doc_id % 17 AS s FROM documents ORDER BY doc_id % 17 DESC, 'd' || doc_id LIMIT 8))
SELECT 'full' AS kind, '{0}' || chr(10) || chr(10) || 'Nodes:' || chr(10) || p.t || chr(10) || chr(10) || 'Excerpts:' || chr(10) || c.t || chr(10) || chr(10) || 'Question: why?' AS prompt FROM p, c
UNION ALL SELECT 'empty', '{0}' || chr(10) || chr(10) || 'Nodes:' || chr(10) || '(no nodes)' || chr(10) || chr(10) || 'Excerpts:' || chr(10) || '(no excerpts)' || chr(10) || chr(10) || 'Question: why?'""".replace("{0}", copilot.INSTRUCTION),
    graph=True,
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of a question, with more nodes and excerpts than it takes, and with none."""
    nodes = stored_graph(spark, sf_dir)[0].where("type = 'module'").select("id", F.col("label").alias("name"), "type", "filePath")
    b = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    chunks = _read(spark, sf_dir, "documents").select(b.alias("id"), b.alias("filePath"), b.alias("name"), F.lit(1).alias("startLine"), F.lit(2).alias("endLine"), F.coalesce("text", F.lit("")).alias("content"), (F.col("doc_id") % 17).alias("similarity"))
    full = copilot.build_prompt("why?", nodes, chunks).select(F.lit("full").alias("kind"), "prompt")
    return full.unionByName(copilot.build_prompt("why?", nodes.limit(0), chunks.limit(0)).select(F.lit("empty").alias("kind"), "prompt"))


@query("SELECT 'user' AS role, 'How does make work?' AS content, NULL::VARCHAR AS intent, NULL::INTEGER AS rating, false AS timed UNION ALL SELECT 'assistant', 'answered', 'trace-flow', 1, true")
def stored_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question asked, stored with its answer, and rated."""
    from graphloam.operators import chunks as chunking
    from graphloam.operators import extract, graph_build

    tables = Tables(spark)
    path, files = tables.folder(), sources(spark, sf_dir).where("repositoryId = 'r0'")
    parsed = tables.write(extract.parse(files))
    nodes, edges = (tables.write(t) for t in graph_build.build_graph(parsed, "r0")[:2])
    chunks = tables.write(vectors.embed_chunks(chunking.chunk(parsed, files), measured, 3))
    result = copilot.ask(nodes, edges, chunks, "How does make work?", "r0", measured, lambda prompt, max_tokens: "answered")
    at = datetime(2024, 5, 1)
    for _ in range(2):
        copilot.store_answer(spark, path, "s1", "How does make work?", result, at)
    rows = spark.read.schema(MESSAGES).parquet(path).dropDuplicates(["id"])
    answer = rows.where("role = 'assistant'").first()["id"]
    return copilot.rate(rows, answer, 1).select("role", "content", "intent", "rating", F.col("durationMs").isNotNull().alias("timed"))


@query(
    f""", one AS (SELECT DISTINCT n.* FROM edges e JOIN nodes t ON t.id = e."targetId" JOIN nodes n ON n.id = e."sourceId" WHERE e.type IN ('CALLS', 'IMPORTS') AND t."filePath" = '{BRAND}')
SELECT 'https://x/pull/1' AS "prUrl", '{BRAND}' AS changed, least(50, count(*))::INTEGER AS impacted, 'seen' AS summary FROM one""",
    graph=True,
)
def stored_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pull request's analysis as it is stored; more than thirty callers, so no second hop."""
    path = Tables(spark).folder()
    nodes, edges = stored_graph(spark, sf_dir)
    pr = spark.createDataFrame([(BRAND, "modified"), ("gone", "removed")], "filename string, status string")
    result = pr_analysis.analyse(nodes, edges, spark.createDataFrame([], CHUNKS), pr, None, measured, lambda prompt, max_tokens: "seen")
    pr_analysis.store_analysis(spark, path, "https://x/pull/1", result, datetime(2024, 5, 1))
    return spark.read.schema(ANALYSES).parquet(path).select("prUrl", F.array_join("changedFiles", ",").alias("changed"), F.size("impactedNodes").alias("impacted"), "summary")


@query(
    f""", d AS (SELECT id, label FROM nodes WHERE "filePath" = '{BRAND}'), one AS (SELECT DISTINCT n.id FROM edges e JOIN d ON d.id = e."targetId" JOIN nodes n ON n.id = e."sourceId" WHERE e.type IN ('CALLS', 'IMPORTS')),
i AS (SELECT id FROM one ORDER BY id LIMIT 50), u AS (SELECT id, 0 AS hop FROM d UNION ALL SELECT id, 1 FROM i), f AS (SELECT id, min(hop) AS hop FROM u GROUP BY id ORDER BY hop, id LIMIT 20)
SELECT 'id' AS kind, id AS value FROM f UNION ALL SELECT 'text', '{BRAND} ' || string_agg(label, ' ' ORDER BY label) FROM d""",
    graph=True,
)
def analysis_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that a search for a pull request's context is confined to, and the text that is searched for."""
    nodes, edges = stored_graph(spark, sf_dir)
    paths = _rows(spark, "path", BRAND)
    direct = graph_query.nodes_for_files(nodes, paths)
    ids = impact.context_ids(direct, impact.impacted_nodes(nodes, edges, paths))
    return ids.select(F.lit("id").alias("kind"), F.col("id").alias("value")).unionByName(impact.query_text(paths, direct).select(F.lit("text").alias("kind"), F.col("text").alias("value")))


@query("""SELECT 'full' AS kind, 'Describe what this change can affect, by file names, in a few sentences.' || chr(10) || chr(10) || 'Changed files:' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || chr(10) || 'Nodes in them:' || chr(10) || 'A (class), unknown file' || chr(10) || chr(10)
  || 'Nodes that depend on them:' || chr(10) || 'B, b.ts, by CALLS' || chr(10) || chr(10) || 'Code:' || chr(10) || left('f' || chr(10) || repeat('x', 3000), 2000) AS prompt
UNION ALL SELECT 'empty', 'Describe what this change can affect, by file names, in a few sentences.' || chr(10) || chr(10) || 'Changed files:' || chr(10) || '(none)' || chr(10) || chr(10) || 'Nodes in them:' || chr(10) || '(none)' || chr(10) || chr(10) || 'Nodes that depend on them:' || chr(10) || '(none)' || chr(10) || chr(10) || 'Code:' || chr(10) || '(none)'""")
def analysis_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27."""
    full = pr_analysis.prompt(["a", "b"], [{"label": "A", "type": "class", "filePath": None}], [{"name": "B", "file": "b.ts", "relationship": "CALLS"}], [{"filePath": "f", "content": "x" * 3000}])
    return spark.createDataFrame([("full", full), ("empty", pr_analysis.prompt([], [], [], []))], "kind string, prompt string")


@query(
    f"""WITH c AS (SELECT c_nationkey AS k, string_agg('c/' || c_custkey, chr(10) ORDER BY c_custkey) FILTER (c_custkey % 10 = 0) AS changed,
  left(string_agg('c/' || c_custkey || chr(10) || c_name || repeat('x', 300), chr(10) || chr(10) ORDER BY c_custkey) FILTER (c_nationkey % 3 <> 0), 2000) AS code FROM customer GROUP BY c_nationkey),
s AS (SELECT s_nationkey AS k, string_agg(s_name || ' (service), ' || CASE WHEN s_suppkey % 2 = 0 THEN 'unknown file' ELSE 's/' || s_suppkey END, chr(10) ORDER BY s_suppkey) AS direct,
  string_agg(s_name || ', s/' || s_suppkey || ', by CALLS', chr(10) ORDER BY s_suppkey) FILTER (s_suppkey % 3 = 0) AS impacted FROM supplier GROUP BY s_nationkey)
SELECT n_nationkey, '{pr_analysis.TASK}' || chr(10) || chr(10) || 'Changed files:' || chr(10) || coalesce(changed, '(none)') || chr(10) || chr(10) || 'Nodes in them:' || chr(10) || coalesce(direct, '(none)') || chr(10) || chr(10)
  || 'Nodes that depend on them:' || chr(10) || coalesce(impacted, '(none)') || chr(10) || chr(10) || 'Code:' || chr(10) || coalesce(code, '(none)') AS prompt
FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey"""
)
def analysis_prompts_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27 over whole tables: an analysis for each nation, of its customers as files and its suppliers as nodes."""
    path = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    in_order = lambda key, when, *fields: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct(F.col(key).alias("at"), F.struct(*fields).alias("x"))))), lambda r: r["x"])
    c = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        in_order("c_custkey", F.col("c_custkey") % 10 == 0, path("c/", "c_custkey").alias("path")).alias("changed"),
        in_order("c_custkey", F.col("c_nationkey") % 3 != 0, path("c/", "c_custkey").alias("filePath"), F.concat("c_name", F.repeat(F.lit("x"), F.lit(300))).alias("content")).alias("excerpts"),
    )
    file = F.when(F.col("s_suppkey") % 2 != 0, path("s/", "s_suppkey"))
    s = _read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        in_order("s_suppkey", F.lit(True), F.col("s_name").alias("label"), F.lit("service").alias("type"), file.alias("filePath")).alias("direct"),
        in_order("s_suppkey", F.col("s_suppkey") % 3 == 0, F.col("s_name").alias("name"), path("s/", "s_suppkey").alias("file"), F.lit("CALLS").alias("relationship")).alias("impacted"),
    )
    rows = _read(spark, sf_dir, "nation").select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    empty = [F.coalesce(F.col(x), F.array().cast(kind)).alias(x) for x, kind in (("changed", "array<struct<path:string>>"), ("direct", "array<struct<label:string,type:string,filePath:string>>"), ("impacted", "array<struct<name:string,file:string,relationship:string>>"), ("excerpts", "array<struct<filePath:string,content:string>>"))]
    flat = rows.select("n_nationkey", *empty).withColumn("changed", F.col("changed.path"))
    return pr_analysis.prompts(flat).select("n_nationkey", "prompt")


@query(f"SELECT {_NODE_SQL} FROM nodes WHERE id = 'n3'", graph=True)
def cited_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17."""
    return graph_query.focus(stored_graph(spark, sf_dir)[0], "n3")


@query("SELECT conv_id, turn, left(text, 60) AS preview, CASE WHEN turn % 3 = 0 THEN '—' WHEN turn * 700 < 1000 THEN (turn * 700) || 'ms' ELSE printf('%.1fs', turn * 0.7) END AS latency, CASE WHEN turn % 2 = 0 THEN 1 ELSE -1 END AS rating FROM conversations WHERE role = 'assistant'")
def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dashboard shows of answers."""
    c = _read(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = c.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("content"), F.when(F.col("turn") % 3 != 0, (F.col("turn") * 700).cast("int")).alias("durationMs"), F.when(F.col("turn") % 2 == 0, 1).otherwise(-1).alias("rating"), F.lit(None).cast("string").alias("intent"))
    part = F.split("id", "/")
    return metrics.answer_rows(rows).select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), "preview", "latency", "rating")


# ------------------------------------------------------------------------------------------------------ scalar functions


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{\"name\":\"' || p_name || '\"}' WHEN 1 THEN '{\"name\":\"' || p_name || '\",\"type\":\"' || p_type || '\"}' ELSE '{}' END AS shown FROM part")
def shown_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are null or empty are not shown."""
    k = F.col("p_partkey") % 3
    entries = F.create_map(F.lit("name"), F.when(k != 2, F.col("p_name")), F.lit("type"), F.when(k == 1, F.col("p_type")).when(k == 0, ""))
    return _read(spark, sf_dir, "part").select("p_partkey", F.to_json(text.shown_metadata(entries)).alias("shown"))


@query("SELECT n_nationkey, 'a-b-' || n_name || '.ts' AS ast, '/data/r' || n_regionkey || '/source' AS dir, CASE WHEN n_nationkey % 2 = 0 THEN 'x/' || n_name ELSE '/other/' || n_name END AS relative FROM nation")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F10."""
    n = _read(spark, sf_dir, "nation")
    odd = F.col("n_nationkey") % 2 == 1
    path = F.concat(F.when(odd, "/a\\b/").otherwise("a/b/"), "n_name", F.lit(".ts"))
    full = F.concat(F.when(odd, "/other/").otherwise("/root/dir/x/"), F.col("n_name"))
    return n.select("n_nationkey", text.ast_name(path).alias("ast"), text.repo_dir("/data", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "source").alias("dir"), text.relative_path(full, F.lit("/root/dir/")).alias("relative"))


@query("""SELECT c_custkey, c_custkey % 4 = 0 AS key_ok, c_custkey % 3 = 0 AS token_ok, CASE WHEN c_custkey % 3 = 2 THEN 'git@github.com:a/b' WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'https://github.com/a/b' ELSE 'http://old@example.org/a' END
  ELSE CASE WHEN c_custkey % 3 = 0 THEN 'https://x-access-token:t%2F' || c_custkey || '@github.com/a/b' ELSE 'http://x-access-token:t%2F' || c_custkey || '@example.org/a' END END AS url FROM customer""")
def token_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys of 64 hexadecimal digits; URLs that may carry a token, and with one."""
    k = F.col("c_custkey")
    digits = F.sha2(k.cast("string"), 256)
    key = F.when(k % 4 == 0, F.upper(digits)).when(k % 4 == 1, F.substring(digits, 1, 63)).when(k % 4 == 2, F.concat(F.substring(digits, 1, 63), F.lit("g")))
    url = F.when(k % 3 == 0, "https://github.com/a/b").when(k % 3 == 1, "http://old@example.org/a").otherwise("git@github.com:a/b")
    token = F.when(k % 5 != 0, F.concat(F.lit("t/"), k.cast("string")))
    return _read(spark, sf_dir, "customer").select("c_custkey", crypto.is_key(key).alias("key_ok"), text.may_carry_token(url).alias("token_ok"), crypto.authenticated_url(url, token).alias("url"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'o/repo' WHEN 1 THEN 'o/my-repo' WHEN 2 THEN '' ELSE 'o/x' END AS repo, CASE n_nationkey % 4 WHEN 3 THEN 'o/x#' || n_nationkey ELSE '' END AS pull, CASE n_nationkey % 2 WHEN 0 THEN 'main' ELSE 'up.to' END AS zip FROM nation")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several shapes."""
    k = F.col("n_nationkey")
    url = F.when(k % 4 == 0, "https://github.com/o/repo.git").when(k % 4 == 1, "git://github.com/o/my-repo/tree/main").when(k % 4 == 2, "https://example.org/o/r").otherwise(F.concat(F.lit("https://github.com/o/x/pull/"), k.cast("string"), F.lit("/files")))
    r, p = text.repo_parts(url), text.pr_parts(url)
    both = lambda s, *more: F.coalesce(F.concat(s["owner"], F.lit("/"), s["repo"], *more), F.lit(""))
    zipped = F.when(k % 2 == 0, "/tmp/main.zip").otherwise("up.to.zip")
    return _read(spark, sf_dir, "nation").select("n_nationkey", both(r).alias("repo"), both(p, F.lit("#"), p["number"].cast("string")).alias("pull"), text.zip_name(zipped).alias("zip"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END AS path FROM nation")
def metadata_path_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Either key, neither, no object, null."""
    k = F.col("n_nationkey") % 5
    json = F.when(k == 0, '{"filePath":"a","path":"z"}').when(k == 1, '{"path":"b"}').when(k == 2, '{"other":1}').when(k == 3, "{broken")
    return _read(spark, sf_dir, "nation").select("n_nationkey", text.metadata_path(json).alias("path"))


_SPELLED = [("src/a/main.ts", "./lib.ts", "src/a/lib.ts"), ("src/a/main.ts", "../lib.ts", "src/lib.ts"), ("src/a/main.ts", ".././../lib", "lib"), ("main.ts", "./x//y/../z.ts", "x/z.ts"), ("src/main.ts", "/abs/p.ts", "src/abs/p.ts"), ("a/main.ts", "../../../up.ts", "../../up.ts"), ("a/b/c.ts", "./.", "a/b")]


@query("SELECT p_partkey, replace(([" + ", ".join(f"'{t}'" for *_, t in _SPELLED) + f"])[(p_partkey % {len(_SPELLED)} + 1)::INTEGER], 'lib', 'lib' || p_partkey) AS target FROM part")
def import_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each part, spelled in seven ways."""
    k = F.col("p_partkey")
    at = (k % len(_SPELLED) + 1).cast("int")
    pick = lambda i: F.replace(F.element_at(F.array(*(F.lit(s[i]) for s in _SPELLED)), at), F.lit("lib"), F.concat(F.lit("lib"), k.cast("string")))
    return _read(spark, sf_dir, "part").select("p_partkey", text.resolve_import(pick(0), pick(1)).alias("target"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'find-ownership' WHEN 1 THEN 'trace-flow' WHEN 2 THEN 'locate-logic' WHEN 3 THEN 'explain-deps' ELSE 'explain-arch' END AS intent FROM events")
def intent_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """any white space between the words of a pattern."""
    n, e = F.col("event_id") % 5, F.col("event_type")
    q = F.when(n == 0, F.concat(F.lit("WHERE\tis\n"), e)).when(n == 1, F.concat(F.lit("what \t happens\nwhen "), e)).when(n == 2, F.concat(F.lit("Find\n all "), e)).when(n == 3, F.concat(F.lit("who\r\nuses "), e)).otherwise(F.concat(F.lit("whereis "), e))
    return _read(spark, sf_dir, "events").select("event_id", text.intent(q).alias("intent"))
