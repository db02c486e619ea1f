"""Reads of the property graph. Every limit has a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Node types that a partial load keeps, and thresholds.
STRUCTURAL_TYPES = ["repository", "service", "module", "file", "controller", "api"]
CLIENT_TYPES = ["repository", "service", "module", "controller"]
SMART_LOAD, CLIENT_LOAD, PAGE = 2000, 2000, 5000
MAX_HOPS = 10
#: Ids up to this many are broadcast; more are joined.
BROADCAST_IDS = 100_000
NODE = ["id", "type", "label", "repositoryId", "filePath", "metadataJson"]


def in_repository(nodes: DataFrame, repository: str | None) -> DataFrame:
    """P1."""
    return nodes if repository is None else nodes.where(F.col("repositoryId") == repository)


def edges_within(nodes: DataFrame, edges: DataFrame, repository: str | None) -> DataFrame:
    """Edges whose ends are both in the repository."""
    ids = in_repository(nodes, repository).select("id")
    return edges.join(ids.withColumnRenamed("id", "sourceId"), "sourceId", "left_semi").join(ids.withColumnRenamed("id", "targetId"), "targetId", "left_semi").select(*edges.columns)


def graph_summary(nodes: DataFrame, edges: DataFrame, repository: str | None = None) -> DataFrame:
    """A1-A3: (kind, type, n): nodes by type, all nodes, all edges within."""
    by_type = in_repository(nodes, repository).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    total = by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    links = edges_within(nodes, edges, repository).agg(F.count(F.lit(1)).alias("n"))
    row = lambda df, kind, t: df.select(F.lit(kind).alias("kind"), t.alias("type"), "n")
    return row(by_type, "type", F.col("type")).unionByName(row(total, "nodes", F.lit(""))).unionByName(row(links, "edges", F.lit("")))


def graph_nodes(nodes: DataFrame, repository: str | None = None, types: list[str] | None = None, limit: int = PAGE, offset: int = 0, threshold: int = SMART_LOAD, kept: list[str] = STRUCTURAL_TYPES, inclusive: bool = True) -> DataFrame:
    """A page of nodes by id. Without types, a repository with `threshold` nodes (inclusive: or exactly as many)
    shows the kept types only; one plan, in which the count joins as a single row."""
    own = in_repository(nodes, repository)
    if types:
        own = own.where(F.col("type").isin(types))
    else:
        n = own.agg(F.count(F.lit(1)).alias("__n"))
        large = F.col("__n") >= threshold if inclusive else F.col("__n") > threshold
        own = own.crossJoin(F.broadcast(n)).where(~large | F.col("type").isin(kept)).drop("__n")  # one row
    return own.orderBy("id").offset(offset).limit(limit)


def graph_edges(nodes: DataFrame, edges: DataFrame, repository: str | None = None) -> DataFrame:
    """All edges within, whatever page of nodes is shown."""
    return edges_within(nodes, edges, repository)


def neighbourhood(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Distinct (direction, edgeType, neighbour columns) of a node, either way; the node itself is a row of
    direction `self`, so that no rows mean no such node."""
    me = nodes.where(F.col("id") == node_id)
    out = edges.where(F.col("sourceId") == node_id).select(F.lit("out").alias("direction"), F.col("type").alias("edgeType"), F.col("targetId").alias("id"))
    into = edges.where(F.col("targetId") == node_id).select(F.lit("in").alias("direction"), F.col("type").alias("edgeType"), F.col("sourceId").alias("id"))
    around = out.unionByName(into).distinct().join(nodes.select(*NODE), "id")
    own = me.select("id", F.lit("self").alias("direction"), F.lit("").alias("edgeType"), *NODE[1:])
    return own.unionByName(around.join(F.broadcast(me.select(F.lit(1).alias("__one")).limit(1)), F.lit(True), "left_semi"))


def neighbourhood_nested(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One row: the node, and arrays of (edgeType, node) for both directions."""
    rows = neighbourhood(nodes, edges, node_id)
    side = lambda d: F.collect_set(F.when(F.col("direction") == d, F.struct("edgeType", *NODE)))
    return rows.agg(F.max(F.when(F.col("direction") == "self", F.struct(*NODE))).alias("node"), side("out").alias("outgoing"), side("in").alias("incoming")).where("node is not null")


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """(position, nodeId, edgeId) of a shortest directed path of 1 to max_hops edges, the source at 0 without an edge; no
    rows if there is none, or for equal ends.

    A breadth-first search from both ends: the smaller frontier goes on, and leaves out what its side has visited, one stored
    table a side. The first level that meets the other side gives the length, so each side goes some half of it. The
    nodes between are then found forwards within the other side's levels. Ties go to the smallest predecessor and edge.
    """
    spark = edges.sparkSession
    from graphloam.plans.durable import Tables

    empty = spark.createDataFrame([], "position int, nodeId string, edgeId string")
    if source == target or max_hops < 1:
        return empty
    with Tables(spark) as tables:
        return _meet(tables, nodes, edges, source, target, max_hops, empty)


class _Side:
    """A side's levels in one folder: (id, via: the smallest neighbour and edge towards this side's end, level). An edge counts if
    its target is a node, which is looked up for the ids of a level only, so that no step shuffles all edges for it."""

    SCHEMA = "id string, via struct<s:string,e:string>, level int"

    def __init__(self, tables, nodes: DataFrame, end: str, steps: DataFrame, near: str, far: str) -> None:  # noqa: ANN001
        self.spark, self.tables, self.folder, self.nodes, self.steps, self.near, self.far = steps.sparkSession, tables, tables.folder(), nodes, steps, near, far
        self.depth, self.size = 0, 1
        self.spark.createDataFrame([(end, None)], "id string, via struct<s:string,e:string>").write.parquet(f"{self.folder}/level=0")

    def level(self, number: int) -> DataFrame:
        return self.visited().where(F.col("level") == number).select("id", "via")

    def visited(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def go_on(self) -> None:
        """One level more."""
        frontier = self.level(self.depth).select(F.col("id").alias(self.near))
        if self.near == "t":
            frontier = frontier.join(_found(self.nodes, frontier.select(F.col("t").alias("id")), self.size).withColumnRenamed("id", "t"), "t")
        reached = _behind(self.steps, frontier, self.near, self.far, self.size)
        new = reached.join(self.visited().select("id"), "id", "left_anti")
        if self.far == "t":
            new = self.tables.write(new)
            new = new.join(_found(self.nodes, new.select("id"), new.count()), "id")
        self.depth += 1
        new.select("id", "via").write.parquet(f"{self.folder}/level={self.depth}")
        self.size = self.level(self.depth).count()


def _few(ids: DataFrame, size: int) -> DataFrame:
    return F.broadcast(ids) if size <= BROADCAST_IDS else ids


def _found(nodes: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id) of the ids, of which there are `size`, that are nodes."""
    return nodes.select("id").join(_few(ids, size), "id", "left_semi").distinct()


def _behind(steps: DataFrame, frontier: DataFrame, near: str, far: str, size: int) -> DataFrame:
    """(id, via) of what the edges of a frontier of `size` ids lead to."""
    return steps.join(_few(frontier, size), near).groupBy(F.col(far).alias("id")).agg(F.min(F.struct(F.col(near).alias("s"), "e")).alias("via")).where("id is not null")


def _meet(tables, nodes: DataFrame, edges: DataFrame, source: str, target: str, max_hops: int, empty: DataFrame) -> DataFrame:  # noqa: ANN001
    spark = edges.sparkSession
    steps = edges.select(F.col("sourceId").alias("s"), F.col("targetId").alias("t"), F.col("id").alias("e"))
    ahead, back = _Side(tables, nodes, source, steps, "s", "t"), _Side(tables, nodes, target, steps, "t", "s")
    while True:
        if ahead.depth + back.depth >= max_hops:
            return empty
        side = ahead if ahead.size <= back.size else back
        side.go_on()
        if not side.size:
            return empty
        met = ahead.level(ahead.depth).select("id").join(back.level(back.depth).select("id"), "id", "left_semi")
        if met.limit(1).count():
            break
    # forwards from where the sides meet, within the levels of the target's side
    between, layer = [], tables.write(met)
    for level in range(back.depth - 1, -1, -1):
        near = _behind(steps, layer.withColumnRenamed("id", "s"), "s", "t", layer.count())
        near = tables.write(near.join(back.level(level).select("id"), "id", "left_semi"))
        layer = tables.write(near.join(_found(nodes, near.select("id"), near.count()), "id"))
        between.append(layer)
        layer = layer.select("id")
    levels = [*(ahead.level(n) for n in range(1, ahead.depth + 1)), *between]
    rows, at = [], target
    for k in range(len(levels), 0, -1):
        via = levels[k - 1].where(F.col("id") == at).first()["via"]
        rows.append((k, at, via["e"]))
        at = via["s"]
    return spark.createDataFrame([(0, source, None), *reversed(rows)], "position int, nodeId string, edgeId string")


def hop_counts(edges: DataFrame, source: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """J9 for all targets: (nodeId, hops) of what 1 to max_hops edges reach; the source itself if a cycle leads back to it.

    By levels: a level's nodes are those behind the edges of the one before that no level had. Each is written, so that work
    grows with the edges that are reached and not with the number of walks."""
    from graphloam.plans.durable import Tables

    spark, levels = edges.sparkSession, []
    tables = Tables(spark)
    steps = edges.select(F.col("sourceId").alias("id"), F.col("targetId").alias("nodeId")).where("id is not null and nodeId is not null")
    frontier, small = spark.createDataFrame([(source,)], "id string"), True
    for hop in range(1, max_hops + 1):
        level = steps.join(F.broadcast(frontier) if small else frontier, "id", "left_semi").select("nodeId").distinct()
        for before in levels:
            level = level.join(before, "nodeId", "left_anti")
        level = tables.write(level)
        n = level.count()
        if not n:
            break
        levels.append(level)
        frontier, small = level.withColumnRenamed("nodeId", "id"), n <= BROADCAST_IDS
        if hop == max_hops:
            break
    out = spark.createDataFrame([], "nodeId string, hops int")
    for hop, level in enumerate(levels, 1):
        out = out.unionByName(level.withColumn("hops", F.lit(hop)))
    return out


def nodes_for_files(nodes: DataFrame, paths: DataFrame, repository: str | None = None) -> DataFrame:
    """Nodes whose filePath is among paths (column path)."""
    return in_repository(nodes, repository).join(paths.select(F.col("path").alias("filePath")).distinct(), "filePath", "left_semi").select(*NODE)


def callers_of(nodes: DataFrame, edges: DataFrame, paths: DataFrame, repository: str | None = None, types: tuple[str, ...] = ("CALLS", "IMPORTS")) -> DataFrame:
    """Distinct (node columns, relationship) of what calls or imports a node of the paths, within the repository."""
    targets = nodes_for_files(nodes, paths, repository).select(F.col("id").alias("targetId"))
    links = edges.where(F.col("type").isin(list(types))).join(targets, "targetId", "left_semi").select("sourceId", F.col("type").alias("relationship")).distinct()
    return links.join(in_repository(nodes, repository).select(*NODE), F.col("sourceId") == F.col("id")).select(*NODE, "relationship")


def expand_undirected(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, repository: str | None = None) -> DataFrame:
    """(hop, node columns) of the anchors (column id; hop 0) and what one or two edges reach, whatever their
    direction. Ends are in the repository, the node between need not be."""
    from graphloam.plans.durable import Tables

    tables = Tables(edges.sparkSession)

    def around(frontier: DataFrame) -> DataFrame:
        """What one edge reaches from a written frontier, which is broadcast if it is small."""
        ids = F.broadcast(frontier) if frontier.count() <= BROADCAST_IDS else frontier
        ways = [edges.join(ids.select(F.col("id").alias(a)), a, "left_semi").select(F.col(b).alias("id")) for a, b in (("sourceId", "targetId"), ("targetId", "sourceId"))]
        return ways[0].unionByName(ways[1]).distinct()

    known = anchors.select("id").distinct()
    start = tables.write(in_repository(nodes, repository).select("id").join(F.broadcast(known) if known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else known, "id", "left_semi"))
    one = tables.write(around(start))
    two = around(one)
    hops = start.withColumn("hop", F.lit(0)).unionByName(one.withColumn("hop", F.lit(1))).unionByName(two.withColumn("hop", F.lit(2))).groupBy("id").agg(F.min("hop").alias("hop"))
    return hops.join(in_repository(nodes, repository).select(*NODE), "id").select("hop", *NODE)


def expand_reverse(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, repository: str | None = None) -> DataFrame:
    """(hop, node columns) of the anchors and of the sources of any edge into them."""
    start = anchors.select("id").distinct().join(in_repository(nodes, repository).select("id"), "id", "left_semi")
    into = edges.join(start.withColumnRenamed("id", "targetId"), "targetId", "left_semi").select(F.col("sourceId").alias("id"))
    hops = start.withColumn("hop", F.lit(0)).unionByName(into.withColumn("hop", F.lit(1))).groupBy("id").agg(F.min("hop").alias("hop"))
    return hops.join(in_repository(nodes, repository).select(*NODE), "id").select("hop", *NODE)


def visible_subgraph(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the visible types and the edges between them."""
    shown = nodes.where(F.col("type").isin(types))
    return shown, edges_within(shown, edges, None)


def search_nodes(nodes: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """The first nodes by id whose label contains the trimmed query, whatever the case; a blank query finds none."""
    wanted = query.strip().lower()
    return nodes.where(F.lower("label").contains(wanted) if wanted else F.lit(False)).orderBy("id").limit(limit)


def hover_focus(edges: DataFrame, node_id: str) -> DataFrame:
    """Ids of the node and of its direct neighbours."""
    one = edges.where(F.col("sourceId") == node_id).select(F.col("targetId").alias("id"))
    two = edges.where(F.col("targetId") == node_id).select(F.col("sourceId").alias("id"))
    return one.unionByName(two).unionByName(edges.sparkSession.createDataFrame([(node_id,)], "id string")).distinct()


def side_panel(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """(bucket, edgeType, neighbour): outgoing CONTAINS are `contains`, other outgoing edges `imports`, incoming ones
    `usedBy`; a self loop counts as outgoing, unknown neighbours are dropped."""
    mine = edges.where((F.col("sourceId") == node_id) | (F.col("targetId") == node_id))
    out = F.col("sourceId") == node_id
    bucket = F.when(out & (F.col("type") == "CONTAINS"), "contains").when(out, "imports").otherwise("usedBy")
    rows = mine.select(bucket.alias("bucket"), F.col("type").alias("edgeType"), F.when(out, F.col("targetId")).otherwise(F.col("sourceId")).alias("id"))
    return rows.join(nodes.select("id", "label", F.col("type").alias("nodeType")), "id").select("bucket", "edgeType", "id", "label", "nodeType")


def merge_by_id(loaded: DataFrame, new: DataFrame) -> DataFrame:
    """The union by id; a new row takes the place of a loaded one."""
    return loaded.join(new.select("id"), "id", "left_anti").select(*loaded.columns).unionByName(new.select(*loaded.columns))


def present_types(nodes: DataFrame, order: list[str]) -> DataFrame:
    """(type, position) of the types that occur, in the given order."""
    return nodes.select("type").distinct().withColumn("position", F.array_position(F.array(*map(F.lit, order)), F.col("type")).cast("int")).where("position > 0").orderBy("position")


def focus(nodes: DataFrame, node_id: str) -> DataFrame:
    """The cited node, if it is there."""
    return nodes.where(F.col("id") == node_id).limit(1)
