"""Every operator as a query over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.functions import text
from graphloam.operators import diff, graph_build, graph_query, impact, layout, metrics, mutate, retrieval, vectors
from graphloam.operators.anchor_index import AnchorIndex
from graphloam.operators.vector_index import VectorIndex
from graphloam.plans.durable import Tables
from graphloam.plans.star_graph import STAR_SQL, stored_graph
from graphloam.streaming import status, webhooks, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NODE = graph_query.NODE
_NODE_SQL = 'id, type, label, "repositoryId", "filePath", "metadataJson"'
BRAND, ORDER = "parts/Brand#2", "orders/1"


def query(sql: str | None, graph: bool = False) -> Callable:
    """Registers a query under its name; graph: the SQL goes on from the star graph's."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (STAR_SQL + sql) if graph else sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return stored_graph(spark, sf_dir)


def _rows(spark: SparkSession, column: str, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


# ------------------------------------------------------------------------------------------------------- graph reads


@query(
    """, ids AS (SELECT id FROM nodes WHERE "repositoryId" = 'r1')
SELECT 'type' AS kind, type, count(*)::BIGINT AS n FROM nodes WHERE "repositoryId" = 'r1' GROUP BY type
UNION ALL SELECT 'nodes', '', count(*)::BIGINT FROM ids
UNION ALL SELECT 'edges', '', count(*)::BIGINT FROM edges WHERE "sourceId" IN (SELECT id FROM ids) AND "targetId" IN (SELECT id FROM ids)""",
    graph=True,
)
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.graph_summary(*_graph(spark, sf_dir), "r1")


@query(
    f""", t AS (SELECT count(*) AS n FROM nodes WHERE "repositoryId" = 'r1')
SELECT {_NODE_SQL} FROM nodes, t WHERE "repositoryId" = 'r1' AND (t.n < 2000 OR type IN ('repository', 'service', 'module', 'file', 'controller', 'api'))
ORDER BY id LIMIT 5000 OFFSET 10""",
    graph=True,
)
def graph_nodes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.graph_nodes(_graph(spark, sf_dir)[0], "r1", offset=10).select(*NODE)


@query(f"SELECT {_NODE_SQL} FROM nodes WHERE \"repositoryId\" = 'r2' AND type IN ('class', 'service') ORDER BY id LIMIT 100 OFFSET 5", graph=True)
def graph_nodes_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.graph_nodes(_graph(spark, sf_dir)[0], "r2", ["class", "service"], limit=100, offset=5).select(*NODE)


@query(
    """SELECT e.* FROM edges e JOIN nodes a ON a.id = "sourceId" JOIN nodes b ON b.id = "targetId" WHERE a."repositoryId" = 'r1' AND b."repositoryId" = 'r1'""",
    graph=True,
)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.graph_edges(*_graph(spark, sf_dir), "r1")


_AROUND_SQL = f""", me AS (SELECT * FROM nodes WHERE id = 'n1'),
around AS (SELECT DISTINCT 'out' AS direction, type AS "edgeType", "targetId" AS other FROM edges WHERE "sourceId" = 'n1'
  UNION SELECT DISTINCT 'in', type, "sourceId" FROM edges WHERE "targetId" = 'n1')
SELECT 'self' AS direction, '' AS "edgeType", {_NODE_SQL} FROM me
UNION ALL SELECT direction, "edgeType", {_NODE_SQL} FROM around JOIN nodes ON id = other"""


@query(_AROUND_SQL, graph=True)
def node_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.neighbourhood(*_graph(spark, sf_dir), "n1")


@query(
    """, walk(id, hops) AS (SELECT 'r1', 0 UNION ALL SELECT "targetId", hops + 1 FROM walk JOIN edges ON "sourceId" = walk.id WHERE hops < 10)
SELECT id AS "nodeId", min(hops) AS hops FROM walk WHERE hops > 0 GROUP BY id""".replace("FROM walk JOIN edges", "FROM walk JOIN (SELECT * FROM edges WHERE type = 'CONTAINS') c"),
    graph=True,
)
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.hop_counts(_graph(spark, sf_dir)[1].where("type = 'CONTAINS'"), "r1")


@query(
    """, walk(id, hops) AS (SELECT 'r0', 0 UNION ALL SELECT c."targetId", hops + 1 FROM walk JOIN edges c ON c."sourceId" = walk.id WHERE hops < 10),
best AS (SELECT min(hops) AS hops FROM walk WHERE id = 's7' AND hops > 0)
SELECT hops::BIGINT AS hops, hops::BIGINT AS steps FROM best WHERE hops IS NOT NULL""",
    graph=True,
)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of the path, and how many of its steps are edges from one of its nodes to the next."""
    nodes, edges = _graph(spark, sf_dir)
    path = graph_query.shortest_path(nodes, edges, "r0", "s7")
    before = path.select((F.col("position") + 1).alias("position"), F.col("nodeId").alias("sourceId"))
    own = path.where("position > 0").join(before, "position").select(F.col("edgeId").alias("id"), "sourceId", F.col("nodeId").alias("targetId"))
    steps = edges.join(F.broadcast(own), ["id", "sourceId", "targetId"])  # own: a row for each hop
    return path.agg(F.max("position").cast("long").alias("hops")).where("hops is not null").crossJoin(steps.agg(F.count(F.lit(1)).alias("steps")))  # one row each


@query(f"SELECT DISTINCT {_NODE_SQL} FROM nodes WHERE \"filePath\" IN ('{BRAND}', 'customers/MACHINERY')", graph=True)
def nodes_for_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.nodes_for_files(_graph(spark, sf_dir)[0], _rows(spark, "path", BRAND, "customers/MACHINERY"))


@query(
    f"""SELECT DISTINCT n.id, n.type, n.label, n."repositoryId", n."filePath", n."metadataJson", e.type AS relationship
FROM edges e JOIN nodes t ON t.id = e."targetId" JOIN nodes n ON n.id = e."sourceId" WHERE e.type IN ('CALLS', 'IMPORTS') AND t."filePath" = '{BRAND}'""",
    graph=True,
)
def impact_callers_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.callers_of(*_graph(spark, sf_dir), _rows(spark, "path", BRAND))


_ALL = "('CALLS', 'IMPORTS', 'CONTAINS')"


@query(
    f""", one AS (SELECT DISTINCT n.*, e.type AS relationship FROM edges e JOIN nodes t ON t.id = e."targetId" JOIN nodes n ON n.id = e."sourceId" WHERE e.type IN {_ALL} AND t."filePath" = '{ORDER}'),
two AS (SELECT DISTINCT n.*, e.type AS relationship FROM edges e JOIN nodes t ON t.id = e."targetId" JOIN nodes n ON n.id = e."sourceId"
  WHERE e.type IN {_ALL} AND t."filePath" IN (SELECT "filePath" FROM one WHERE "filePath" <> '') AND (SELECT count(*) FROM one) < 30),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hop, relationship) AS rn FROM (SELECT 1 AS hop, * FROM one UNION ALL SELECT 2, * FROM two))
SELECT hop, id AS "nodeId", "filePath" AS file, label AS name, relationship FROM ranked WHERE rn = 1 ORDER BY hop, id LIMIT 50""",
    graph=True,
)
def impact_2hop_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.impacted_nodes(*_graph(spark, sf_dir), _rows(spark, "path", ORDER), types=("CALLS", "IMPORTS", "CONTAINS"))


@query(
    f""", one AS (SELECT DISTINCT n."filePath" FROM edges e JOIN nodes t ON t.id = e."targetId" JOIN nodes n ON n.id = e."sourceId" WHERE e.type IN ('CALLS', 'IMPORTS') AND t."filePath" = '{BRAND}')
SELECT "filePath" AS path FROM one WHERE "filePath" <> ''""",
    graph=True,
)
def impact_caller_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.caller_paths(graph_query.callers_of(*_graph(spark, sf_dir), _rows(spark, "path", BRAND)))


_BOTH_SQL = """, both_ways AS (SELECT "sourceId" AS a, "targetId" AS b FROM edges UNION SELECT "targetId", "sourceId" FROM edges)"""


@query(
    f"""{_BOTH_SQL}, h AS (SELECT 's1' AS id, 0 AS hop UNION ALL SELECT b, 1 FROM both_ways WHERE a = 's1'
  UNION ALL SELECT y.b, 2 FROM both_ways x JOIN both_ways y ON x.b = y.a WHERE x.a = 's1'),
m AS (SELECT id, min(hop) AS hop FROM h GROUP BY id)
SELECT hop, {_NODE_SQL} FROM m JOIN nodes USING (id)""",
    graph=True,
)
def expand_undirected_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.expand_undirected(*_graph(spark, sf_dir), _rows(spark, "id", "s1"))


@query(
    f""", h AS (SELECT id, 0 AS hop FROM nodes WHERE id IN ('p1', 'n2') UNION ALL SELECT "sourceId", 1 FROM edges WHERE "targetId" IN ('p1', 'n2')),
m AS (SELECT id, min(hop) AS hop FROM h GROUP BY id)
SELECT hop, {_NODE_SQL} FROM m JOIN nodes USING (id)""",
    graph=True,
)
def reverse_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.expand_reverse(*_graph(spark, sf_dir), _rows(spark, "id", "p1", "n2"))


@query(
    f"""SELECT {_NODE_SQL} FROM nodes WHERE label IS NOT NULL AND (contains(lower(label), 'widget') OR contains(lower("metadataJson"), 'widget') OR contains(lower(label), 'machinery') OR contains(lower("metadataJson"), 'machinery'))
ORDER BY id LIMIT 5""",
    graph=True,
)
def anchor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.find_anchors(_graph(spark, sf_dir)[0], ["widget", "machinery"]).select(*NODE)


@query(
    f"""SELECT {_NODE_SQL}, w AS word FROM (VALUES ('machinery'), ('der 1'), ('th'), ('"'), ('nothing such')) AS words(w), nodes WHERE label IS NOT NULL AND (contains(lower(label), w) OR contains(lower("metadataJson"), w))
QUALIFY row_number() OVER (PARTITION BY w ORDER BY id) <= 5""",
    graph=True,
)
def anchor_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, L2 through stored postings: the anchors of long and short keywords, the scan's rows."""
    index = AnchorIndex(spark, Tables(spark).folder())
    index.build(_graph(spark, sf_dir)[0])
    out = None
    for word in ("machinery", "der 1", "th", '"', "nothing such"):
        found = index.find([word]).withColumn("word", F.lit(word))
        out = found if out is None else out.unionByName(found)
    return out


@query(
    """SELECT id, label AS name, type, "filePath" FROM nodes WHERE type IN ('repository', 'file', 'module', 'service', 'controller', 'class') AND label IS NOT NULL AND "repositoryId" = 'r3' ORDER BY id LIMIT 50""",
    graph=True,
)
def root_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.as_retrieved(retrieval.root_nodes(_graph(spark, sf_dir)[0], "r3"))


@query(
    """, t AS (SELECT id FROM nodes WHERE label IS NOT NULL AND (contains(lower(label), 'nation_7') OR contains(lower("metadataJson"), 'nation_7')) ORDER BY id LIMIT 5),
h AS (SELECT id, 0 AS hop FROM t UNION ALL SELECT "sourceId", 1 FROM edges WHERE "targetId" IN (SELECT id FROM t)),
m AS (SELECT id, min(hop) AS hop FROM h GROUP BY id)
SELECT id, label AS name, type, "filePath" FROM m JOIN nodes USING (id) ORDER BY hop, id LIMIT 50""",
    graph=True,
)
def retrieve_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the keyword rule deletes the underscore of a question, so the anchors' words are given
    nodes, edges = _graph(spark, sf_dir)
    anchors = retrieval.find_anchors(nodes, ["nation_7"])
    return retrieval.as_retrieved(graph_query.expand_reverse(nodes, edges, anchors).orderBy("hop", "id").limit(retrieval.MAX_NODES))


@query(
    """SELECT CASE WHEN "sourceId" = 'n1' AND e.type = 'CONTAINS' THEN 'contains' WHEN "sourceId" = 'n1' THEN 'imports' ELSE 'usedBy' END AS bucket, e.type AS "edgeType", n.id, n.label, n.type AS "nodeType"
FROM edges e JOIN nodes n ON n.id = CASE WHEN "sourceId" = 'n1' THEN "targetId" ELSE "sourceId" END WHERE "sourceId" = 'n1' OR "targetId" = 'n1'""",
    graph=True,
)
def side_panel_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.side_panel(*_graph(spark, sf_dir), "n1")


@query("""SELECT e.* FROM edges e SEMI JOIN (SELECT id FROM nodes WHERE type IN ('class', 'service')) a ON a.id = "sourceId" SEMI JOIN (SELECT id FROM nodes WHERE type IN ('class', 'service')) b ON b.id = "targetId\"""", graph=True)
def visible_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.visible_subgraph(*_graph(spark, sf_dir), ["class", "service"])[1]


@query(f"SELECT {_NODE_SQL} FROM nodes WHERE contains(lower(label), 'ring') ORDER BY id LIMIT 8", graph=True)
def node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.search_nodes(_graph(spark, sf_dir)[0], " Ring ").select(*NODE)


@query("""SELECT 's3' AS id UNION SELECT "targetId" FROM edges WHERE "sourceId" = 's3' UNION SELECT "sourceId" FROM edges WHERE "targetId" = 's3'""", graph=True)
def hover_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_query.hover_focus(_graph(spark, sf_dir)[1], "s3")


@query("SELECT DISTINCT type, CASE type WHEN 'repository' THEN 1 WHEN 'service' THEN 2 WHEN 'module' THEN 3 WHEN 'file' THEN 4 WHEN 'class' THEN 5 WHEN 'external_dependency' THEN 11 END::INTEGER AS position FROM nodes", graph=True)
def present_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloam.schemas import NODE_TYPES

    return graph_query.present_types(_graph(spark, sf_dir)[0], NODE_TYPES)


# ------------------------------------------------------------------------------------------------ graph construction


@query("""SELECT e.* FROM edges e SEMI JOIN (SELECT id FROM nodes WHERE type <> 'external_dependency') a ON a.id = "sourceId" SEMI JOIN (SELECT id FROM nodes WHERE type <> 'external_dependency') b ON b.id = "targetId\"""", graph=True)
def edge_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graph_build.resolve_endpoints(edges, nodes.where("type <> 'external_dependency'"))


@query("""SELECT type, count(*)::BIGINT AS dropped FROM edges WHERE "targetId" NOT IN (SELECT id FROM nodes WHERE type <> 'external_dependency') GROUP BY type""", graph=True)
def edge_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graph_build.dangling(edges, nodes.where("type <> 'external_dependency'")).groupBy("type").agg(F.count(F.lit(1)).alias("dropped"))


@query(
    f""", u AS (SELECT *, 1 AS o FROM nodes UNION ALL SELECT id, type, label || '!', "repositoryId", "filePath", "metadataJson", 2 FROM nodes WHERE type <> 'class'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC) AS rn FROM u)
SELECT {_NODE_SQL} FROM r WHERE rn = 1""",
    graph=True,
)
def node_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _graph(spark, sf_dir)[0]
    later = nodes.where("type <> 'class'").withColumn("label", F.concat("label", F.lit("!"))).withColumn("ordinal", F.lit(2))
    return graph_build.last_wins(nodes.withColumn("ordinal", F.lit(1)).unionByName(later)).select(*NODE)


@query(
    f""", fresh AS (SELECT id, type, upper(label) AS label, "repositoryId", "filePath", "metadataJson" FROM nodes WHERE type = 'service' UNION ALL SELECT id || 'x', type, label, "repositoryId", "filePath", "metadataJson" FROM nodes WHERE type = 'module')
SELECT {_NODE_SQL} FROM nodes WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT {_NODE_SQL} FROM fresh""",
    graph=True,
)
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _graph(spark, sf_dir)[0].select(*NODE)
    fresh = nodes.where("type = 'service'").withColumn("label", F.upper("label")).unionByName(nodes.where("type = 'module'").withColumn("id", F.concat("id", F.lit("x"))))
    return mutate.merge_nodes(nodes, fresh)


@query(
    f""", gone AS (SELECT id FROM nodes WHERE "filePath" = 'customers/MACHINERY' AND "repositoryId" = 'r1')
SELECT * FROM edges WHERE "sourceId" NOT IN (SELECT id FROM gone) AND "targetId" NOT IN (SELECT id FROM gone)""",
    graph=True,
)
def delete_for_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return mutate.delete_for_files(nodes, edges, _rows(spark, "path", "customers/MACHINERY"), "r1")[1]


# ------------------------------------------------------------------------------------------------- diffs and chunks

_DISK = "SELECT CASE WHEN lang = 'de' THEN 'moved/' ELSE 'd/' END || doc_id AS path, sha256(CASE WHEN lang = 'fr' THEN text || '+' ELSE text END) AS h FROM documents"
_REGISTRY = "SELECT 'd/' || doc_id AS path, sha256(text) AS h FROM documents"
_DIFF = f"""SELECT coalesce(a.path, b.path) AS path, coalesce(a.h, b.h) AS "contentHash",
  CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS bucket
FROM ({_DISK}) a FULL JOIN ({_REGISTRY}) b ON a.path = b.path"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = _read(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    disk = d.select(F.concat(F.when(F.col("lang") == "de", "moved/").otherwise("d/"), number).alias("path"), text.content_hash(F.when(F.col("lang") == "fr", F.concat("text", F.lit("+"))).otherwise(F.col("text"))).alias("contentHash"))
    return disk, d.select(F.concat(F.lit("d/"), number).alias("path"), text.content_hash(F.col("text")).alias("contentHash"))


@query(_DIFF)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.snapshot_diff(*_snapshots(spark, sf_dir))


@query(f"SELECT (count(*) FILTER (bucket = 'new'))::BIGINT AS new, (count(*) FILTER (bucket = 'changed'))::BIGINT AS changed, (count(*) FILTER (bucket = 'unchanged'))::BIGINT AS unchanged, (count(*) FILTER (bucket = 'deleted'))::BIGINT AS deleted FROM ({_DIFF})")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.bucket_counts(diff.snapshot_diff(*_snapshots(spark, sf_dir)))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, left(array_to_string(string_split(text, chr(10))[1:50], chr(10)), 2000) AS content, len(string_split(left(array_to_string(string_split(text, chr(10))[1:50], chr(10)), 2000), chr(10)))::INTEGER AS end_line FROM documents")
def chunk_file_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _read(spark, sf_dir, "documents").select("doc_id", text.file_preview(F.col("text")).alias("content"))
    return out.withColumn("end_line", text.line_count(F.col("content")))


@query("SELECT doc_id, left(array_to_string(string_split(text, chr(10))[2:4], chr(10)), 2000) AS content FROM documents")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("content"))


@query("SELECT doc_id, unnest(range(len(ls)))::INTEGER + 1 AS position, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def chunk_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of each text, whole, with its position from 1."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line")).withColumn("position", F.col("position") + 1)


@query(
    r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]+)"', 1)) AS source, unnest(range(len(regexp_extract_all(html, '<a[^>]*href="([^"]+)"', 1)))) AS position FROM pages)
SELECT page_id, position::INTEGER AS position, source, CASE WHEN left(source, 1) IN ('/', '.') THEN false ELSE true END AS is_external,
  CASE WHEN left(source, 1) IN ('/', '.') THEN 'page:' || regexp_replace(source, '^/+', '') ELSE 'external:' || source END AS target FROM h"""
)
def html_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]+)"'), F.lit(1))).alias("position", "source"))
    external = text.is_external(F.col("source"))
    inside = F.concat(F.lit("page:"), text.normalise_path(F.col("source")))
    return rows.select("page_id", "position", "source", external.alias("is_external"), F.when(external, F.concat(F.lit("external:"), "source")).otherwise(inside).alias("target"))


# ------------------------------------------------------------------------------------------------------ questions

_ASK = "CASE event_id % 6 WHEN 0 THEN 'Where is the ' || event_type || ' handled?' WHEN 1 THEN 'How does ' || event_type || ' work?' WHEN 2 THEN 'Find all ' || event_type || ' handlers' WHEN 3 THEN 'What breaks without ' || event_type || '?' WHEN 4 THEN 'Explain ' || event_type ELSE 'and ' || event_type || '?' END"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = F.col("event_id") % 6, F.col("event_type")
    q = (
        F.when(n == 0, F.concat(F.lit("Where is the "), e, F.lit(" handled?"))).when(n == 1, F.concat(F.lit("How does "), e, F.lit(" work?"))).when(n == 2, F.concat(F.lit("Find all "), e, F.lit(" handlers")))
        .when(n == 3, F.concat(F.lit("What breaks without "), e, F.lit("?"))).when(n == 4, F.concat(F.lit("Explain "), e)).otherwise(F.concat(F.lit("and "), e, F.lit("?")))
    )
    return _read(spark, sf_dir, "events").select("event_id", q.alias("question"))


@query(
    f"""SELECT event_id, question, CASE WHEN regexp_matches(lower(question), 'where\\s+is|who\\s+handles|which\\s+service|what\\s+is\\s+responsible|who\\s+owns') THEN 'find-ownership'
  WHEN regexp_matches(lower(question), 'how\\s+does|what\\s+happens\\s+when|trace|walk\\s+me|step\\s+through|flow') THEN 'trace-flow'
  WHEN regexp_matches(lower(question), 'where\\s+are|find\\s+all|locate|show\\s+me\\s+all') THEN 'locate-logic'
  WHEN regexp_matches(lower(question), 'what\\s+breaks|what\\s+depends|what\\s+imports|who\\s+uses|what\\s+calls') THEN 'explain-deps' ELSE 'explain-arch' END AS intent
FROM (SELECT event_id, {_ASK} AS question FROM events)"""
)
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("event_id", "question", text.intent(F.col("question")).alias("intent"))


@query(
    f"""WITH w AS (SELECT conv_id, turn, regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+') AS ws FROM conversations),
k AS (SELECT conv_id, turn, list_filter(ws, lambda x: length(x) > 2 AND NOT list_contains([{", ".join(repr(s) for s in text.STOP_WORDS)}], x)) AS ks FROM w)
SELECT conv_id, turn, unnest(range(len(ks)))::INTEGER AS position, unnest(ks) AS keyword FROM k"""
)
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.keywords(F.col("text"))).alias("position", "keyword"))


# -------------------------------------------------------------------------------------------------------- vectors

_NEAR = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))"


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector; none, which no row is near to, if the table hasn't that row."""
    row = _read(spark, sf_dir, "embeddings").where("vec_id = 7").first()
    return [float(x) for x in row["embedding"] or []] if row else []


@query(f"SELECT vec_id, round({_NEAR}, 6) AS similarity FROM embeddings ORDER BY {_NEAR} DESC, vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.cosine_topk(_read(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), key="vec_id")
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, round({_NEAR}, 6) AS similarity FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY {_NEAR} DESC, vec_id LIMIT 10")
def graph_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    out = vectors.cosine_topk(_read(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), ids, key="vec_id", node="vec_id")
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


_ALL_NEAR = """SELECT query_id, vec_id, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS place FROM (
    SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
    FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND {})) WHERE place <= 10"""


def _all_near(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.cosine_topk_many(e, asked, ids, key="vec_id", node="vec_id").withColumn("similarity", F.round("similarity", 6))


@query(_ALL_NEAR.format("true"))
def cosine_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cosine_topk for all rows whose id 50 divides."""
    return _all_near(spark, sf_dir)


@query(_ALL_NEAR.format("e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def graph_filtered_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_filtered_topk for all rows whose id 50 divides."""
    return _all_near(spark, sf_dir, _read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")))


def _index(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    """An index of all embeddings, and the queries: all rows whose id 50 divides."""
    e = _read(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, Tables(spark).folder())
    index.build(e, key="vec_id", node="vec_id", dimension=e.select(F.max(F.size("embedding"))).first()[0])
    return index, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_ALL_NEAR.format("true"))
def index_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 through the stored index: lists that cannot hold a nearer row are left out."""
    index, asked = _index(spark, sf_dir)
    return index.search(asked, exact=True).select("query_id", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(_ALL_NEAR.format("e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def index_filtered_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 through the stored index."""
    index, asked = _index(spark, sf_dir)
    nodes = _read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return index.search(asked, nodes=nodes, exact=True).select("query_id", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % 50 = 0")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 by the lists that the index's audit asked for: whether the ten nearest of all queries are recalled to 0.95."""
    index, asked = _index(spark, sf_dir)
    found, true = index.search(asked), _all_near(spark, sf_dir)
    hit = found.join(true, (found["query_id"] == true["query_id"]) & (found["key"] == true["vec_id"]), "left_semi").agg(F.count(F.lit(1)).alias("hit"))
    counts = true.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(hit).select("queries", (F.col("hit") >= 0.95 * F.col("n")).alias("recalled"))  # one row each


# -------------------------------------------------------------------------------------------------------- streams

_ROUTE = """CASE WHEN event_type = 'view' THEN 'ping' WHEN event_type <> 'click' THEN 'not a push'
  WHEN k % 2 = 1 THEN 'other branch' WHEN k % 10 = 0 THEN 'same commit' END"""


@query(f"SELECT event_id, CASE WHEN reason IS NULL THEN 'ACCEPTED' ELSE 'SKIPPED' END AS status, reason FROM (SELECT event_id, {_ROUTE} AS reason FROM (SELECT *, (json_extract(props, '$.k'))::INTEGER AS k FROM events))")
def events_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.when(F.col("event_type") == "view", "ping").when(F.col("event_type") == "click", "push").otherwise(F.col("event_type"))
    ref = F.when(k % 2 == 1, "refs/heads/side").otherwise("refs/heads/main")
    reason = webhooks.skip_reason(event, ref, (k % 10).cast("string"), text.tracked_ref(F.lit(None).cast("string"), F.lit(None).cast("string")), F.lit("0"))
    return _read(spark, sf_dir, "events").select("event_id", F.when(reason.isNull(), "ACCEPTED").otherwise("SKIPPED").alias("status"), reason.alias("reason"))


@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY part) AS rn
FROM (SELECT *, 1 AS part FROM events UNION ALL SELECT * REPLACE (value + 1 AS value), 2 FROM events WHERE event_type = 'click')) WHERE rn = 1""")
def events_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    again = e.where("event_type = 'click'").withColumn("value", F.col("value") + 1)
    return mutate.insert_absent(e, again, ["event_id"])


@query("SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type, max(event_id) FILTER (true) * 0 + arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id FROM events GROUP BY user_id")
def events_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return mutate.latest_by_key(e, "user_id", "ts", "event_id").select("user_id", "event_type", "event_id")


_STATUSES = ["PENDING", "ACCEPTED", "PROCESSED", "FAILED", "SKIPPED", "PENDING", "ACCEPTED"]
_STEPS = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ts, st) AS rn FROM (SELECT event_id // 4 AS d, ts, ({_STATUSES!r})[((event_id * 11 + user_id) % 7 + 1)::INTEGER] AS st FROM events)),
m AS (SELECT d, ts, st, rn, '' AS was, st = 'PENDING' AS ok FROM e WHERE rn = 1
  UNION ALL SELECT d, ts, st, rn, now, (now = '' AND st = 'PENDING') OR (now = 'PENDING' AND st IN ('SKIPPED', 'ACCEPTED', 'FAILED')) OR (now = 'ACCEPTED' AND st IN ('PROCESSED', 'FAILED'))
  FROM (SELECT e.*, CASE WHEN m.ok THEN m.st ELSE m.was END AS now FROM m JOIN e ON e.d = m.d AND e.rn = m.rn + 1))
SELECT 'd' || d AS "deliveryId", ts AS at, st AS status, was AS before, ok AS accepted FROM m"""


def _delivery_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _STATUSES)), ((F.col("event_id") * 11 + F.col("user_id")) % 7 + 1).cast("int"))
    number = F.floor(F.col("event_id") / 4).cast("string")
    return _read(spark, sf_dir, "events").select(F.concat(F.lit("d"), number).alias("deliveryId"), F.col("ts").cast("timestamp").alias("at"), kind.alias("status"), "event_id")


@query(_STEPS)
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: which events change a delivery's status, and which are refused."""
    return status.transitions(_delivery_events(spark, sf_dir)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(_STEPS)
def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 as a stream, whose events come in another order than they happened: by their numbers' last digits, then two later ones
    that let the watermark pass all others. The stream is run for each part as it has come, so that a part is one batch,
    however many files it has."""
    base, rows = Tables(spark).folder(), _delivery_events(spark, sf_dir)
    last = rows.agg(F.max("at").alias("at"))
    parts = [rows.where(F.col("event_id") % 3 == 2 - part).drop("event_id") for part in range(3)]
    parts += [last.select(F.lit("end").alias("deliveryId"), (F.col("at") + F.make_dt_interval(F.lit(days))).alias("at"), F.lit("PENDING").alias("status")) for days in (1000, 1001)]
    schema = "deliveryId string, at timestamp, status string"
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        found = status.transition_stream(stream, "400 days").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        found.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(status.OUT).parquet(f"{base}/out").where("deliveryId <> 'end'").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(_read(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM g GROUP BY user_id, g"""
)
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(_read(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# ------------------------------------------------------------------------------------------------------ dashboards


@query("SELECT conv_id, turn, left(text, 60) AS preview FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user') ORDER BY turn DESC, conv_id LIMIT 100")
def latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    messages = c.select(F.col("conv_id").alias("id"), F.col("conv_id").alias("sessionId"), "role", F.col("turn").alias("createdAt"), "text")
    sessions = c.where("role = 'user'").select(F.col("conv_id").alias("id"))
    return metrics.latest_answers(messages, sessions).select(F.col("id").alias("conv_id"), F.col("createdAt").alias("turn"), text.preview(F.col("text")).alias("preview"))


@query("SELECT (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS ready, count(*)::BIGINT AS total, sum(o_custkey)::BIGINT AS \"fileCount\", sum(o_orderkey)::BIGINT AS \"nodeCount\", 0::BIGINT AS \"edgeCount\" FROM orders")
def workspace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    rows = o.select(F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending").alias("status"), F.col("o_custkey").alias("fileCount"), F.col("o_orderkey").alias("nodeCount"), F.lit(None).cast("long").alias("edgeCount"))
    return metrics.workspace_stats(rows)


@query("SELECT source AS \"repositoryId\", list_sort(list(DISTINCT CASE lang WHEN 'en' THEN 'typescript' WHEN 'de' THEN 'python' WHEN 'fr' THEN 'java' END) FILTER (lang IN ('en', 'de', 'fr')))::VARCHAR AS languages FROM documents GROUP BY source")
def language_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloam.sources import tree

    ext = F.element_at(F.create_map(F.lit("en"), F.lit("TS"), F.lit("de"), F.lit("py"), F.lit("fr"), F.lit("java")), F.col("lang"))
    files = _read(spark, sf_dir, "documents").select(F.col("source").alias("repositoryId"), F.concat_ws(".", F.concat(F.lit("a/"), F.col("doc_id").cast("string")), F.coalesce(ext, F.lit("txt"))).alias("path"))
    return tree.languages(files).select("repositoryId", F.concat(F.lit("["), F.array_join("languages", ", "), F.lit("]")).alias("languages"))


@query("SELECT n_nationkey, round(12 * sqrt(n_nationkey::DOUBLE) * cos(n_nationkey * pi() * (3 - sqrt(5::DOUBLE))), 6) + 0 AS x, round(12 * sqrt(n_nationkey::DOUBLE) * sin(n_nationkey * pi() * (3 - sqrt(5::DOUBLE))), 6) + 0 AS y FROM nation")
def layout_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = layout.spiral(F.col("n_nationkey"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", (F.round(at["x"], 6) + F.lit(0.0)).alias("x"), (F.round(at["y"], 6) + F.lit(0.0)).alias("y"))


@query("SELECT event_id, CASE WHEN v < 1000 THEN v || 'ms' ELSE printf('%.1fs', v / 1000.0) END AS latency FROM (SELECT event_id, (value * 100)::BIGINT AS v FROM (SELECT event_id, floor(value) AS value FROM events))")
def latency_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", text.duration_label((F.floor("value") * 100).cast("long")).alias("latency"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").withColumns({"sessionId": F.col("conv_id").cast("string"), "createdAt": F.col("turn"), "id": F.col("turn")})
    return metrics.history(c, "3").select("conv_id", "turn", "role", "text")


@query("SELECT c_custkey, c_name, coalesce(CASE WHEN o.n IS NULL THEN NULL ELSE o.best END, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return mutate.partial_update(_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), changes, "c_custkey")


@query("SELECT url, regexp_replace(split_part(regexp_replace(url, '/+$', ''), '/', -1), '\\.git$', '') AS name FROM pages")
def repo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("url", text.repo_name(F.col("url")).alias("name"))


# ------------------------------------------------------------------------------------------- scalar functions on tables


@query("SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' ELSE (s // 3600) || 'h ago' END AS age FROM (SELECT event_id, epoch(TIMESTAMP '2024-03-01')::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS s FROM events)")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    return _read(spark, sf_dir, "events").select("event_id", text.age_label(F.col("ts").cast("timestamp"), now).alias("age"))


@query(
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'src/' || source || '/lib.ts' WHEN lang = 'de' THEN 'src/lib.ts' WHEN lang = 'fr' THEN 'lib.ts' ELSE '../lib.ts' END AS target FROM documents"""
)
def import_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.when(F.col("lang") == "en", "./lib.ts").when(F.col("lang") == "de", "../lib.ts").when(F.col("lang") == "fr", ".././../lib.ts").otherwise("../../x/../../lib.ts")
    here = F.concat(F.lit("src/"), "source", F.lit("/main.ts"))
    return _read(spark, sf_dir, "documents").select("doc_id", text.resolve_import(here, spelled).alias("target"))


def _opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts sealed and opened again; sealed: the token has its prefix and opens to the text."""
    from graphloam.functions import crypto

    key = F.sha2(F.col("source"), 256)
    rows = _read(spark, sf_dir, "documents").select("doc_id", "text", key.alias("key"), crypto.encrypt(F.col("text"), key).alias("token"))
    opened = rows.select("doc_id", "text", "token", crypto.decrypt(F.col("token"), F.col("key")).alias("opened"))
    return opened.select("doc_id", "opened", (F.col("token").startswith("v1:") & (F.col("opened") == F.col("text"))).alias("sealed"))


@query("SELECT doc_id, sha256(text) AS opened, true AS sealed FROM documents")
def token_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, compared by their hashes; token_encryption_whole shows them."""
    return _opened(spark, sf_dir).withColumn("opened", F.sha2("opened", 256))


@query("SELECT doc_id, text AS opened, true AS sealed FROM documents")
def token_encryption_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened(spark, sf_dir)


@query("SELECT event_id, event_type <> 'click' AS ok FROM events")
def webhook_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloam.functions import crypto

    body = F.col("props").cast("binary")
    secret = F.concat(F.lit("secret-"), F.col("user_id").cast("string"))
    signed = F.concat(F.lit("sha256="), crypto.hmac_sha256(secret.cast("binary"), F.when(F.col("event_type") == "click", F.lit("other").cast("binary")).otherwise(body)))
    return _read(spark, sf_dir, "events").select("event_id", crypto.signature_ok(secret, body, signed).alias("ok"))


@query("SELECT page_id, regexp_extract(u, 'github\\.com/([^/]+)/', 1) AS owner, regexp_extract(u, '/pull/(\\d+)', 1)::INTEGER AS number FROM (SELECT page_id, 'https://github.com/o' || (page_id % 5) || '/r/pull/' || page_id AS u FROM pages)")
def pr_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://github.com/o"), (F.col("page_id") % 5).cast("string"), F.lit("/r/pull/"), F.col("page_id").cast("string"))
    return _read(spark, sf_dir, "pages").select("page_id", text.pr_parts(url).alias("p")).select("page_id", "p.owner", "p.number")


@query("""SELECT id, "filePath" AS path FROM nodes""", graph=True)
def metadata_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0].select("id", text.metadata_path(F.col("metadataJson")).alias("path"))


@query("SELECT c.* FROM conversations c ANTI JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') s USING (conv_id)")
def delete_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    return mutate.delete_by_keys(c, c.where("role = 'system'").select("conv_id"))[0]


@query(
    """SELECT id, label FROM nodes WHERE type = 'repository' UNION ALL SELECT id, label || '!' FROM nodes WHERE type = 'module' UNION ALL SELECT id || '+', label FROM nodes WHERE type = 'service'""",
    graph=True,
)
def merge_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows take the place of loaded ones, others are added."""
    nodes = _graph(spark, sf_dir)[0].select(*NODE)
    loaded = nodes.where("type IN ('repository', 'module')")
    new = nodes.where("type = 'module'").withColumn("label", F.concat("label", F.lit("!"))).unionByName(nodes.where("type = 'service'").withColumn("id", F.concat("id", F.lit("+"))))
    return graph_query.merge_by_id(loaded, new).select("id", "label")


@query("SELECT conv_id, turn, sha256(conv_id || '|' || turn || '|' || role) AS id FROM conversations")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", mutate.stable_id(F.col("conv_id"), F.col("turn"), F.col("role")).alias("id"))
