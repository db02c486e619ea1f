"""Parsed files to a property graph: nodes, edges, endpoint resolution. No UDF: explode, select and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.functions import text
from graphloam.operators.extract import has_facts

_NODE = ["id", "type", "label", "repositoryId", "filePath", "metadataJson"]


def _json(**fields: Column) -> Column:
    """without null fields."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def _node(rows: DataFrame, node_id: Column, kind: Column, label: Column, metadata: Column, position: Column, file_path: Column) -> DataFrame:
    return rows.select(node_id.alias("id"), kind.alias("type"), label.alias("label"), F.col("repositoryId"), file_path.alias("filePath"), metadata.alias("metadataJson"), F.struct(F.col("path"), position.alias("position")).alias("ordinal"))


def _edge(rows: DataFrame, kind: str, source: Column, target: Column, position: Column, **properties: Column) -> DataFrame:
    props = F.map_filter(F.create_map(*(x for k, c in properties.items() for x in (F.lit(k), c.cast("string")))), lambda _, v: v.isNotNull()) if properties else F.create_map().cast("map<string,string>")
    return rows.select(F.lit(kind).alias("type"), source.alias("sourceId"), target.alias("targetId"), props.alias("properties"), F.col("path"), position.alias("position"))


def _pieces(parsed: DataFrame) -> dict[str, DataFrame]:
    file_id = F.col("id")
    classes = parsed.select("repositoryId", "path", file_id.alias("fileId"), F.posexplode("classes").alias("c", "cls")).withColumn("classId", F.concat("repositoryId", F.lit(":"), "path", F.lit("#"), F.col("cls.name")))
    return {
        "classes": classes,
        "methods": classes.select("repositoryId", "path", "classId", "c", F.posexplode("cls.methods").alias("m", "fn")).withColumn("nodeId", F.concat("classId", F.lit("#"), F.col("fn.name"))),
        "functions": parsed.select("repositoryId", "path", file_id.alias("fileId"), F.posexplode("functions").alias("f", "fn")).withColumn("nodeId", F.concat("fileId", F.lit("#"), F.col("fn.name"))),
        "imports": parsed.select("repositoryId", "path", file_id.alias("fileId"), F.posexplode("imports").alias("i", "imp")),
    }


def _at(*parts: Column) -> Column:
    """A position within a file that sorts as the facts do."""
    return F.array(*(p.cast("int") for p in parts))


def to_nodes(parsed: DataFrame) -> DataFrame:
    """Nodes with an ordinal (path and position); ids may repeat, see last_wins()."""
    p, lit = _pieces(parsed), F.lit
    files = _node(parsed, F.col("id"), text.node_type(F.col("path"), F.col("frameworkHints")), text.basename(F.col("path")), _json(path=F.col("path"), language=F.col("language"), contentHash=F.col("contentHash")), _at(lit(0)), F.col("path"))
    cls = F.col("cls")
    classes = _node(p["classes"], F.col("classId"), F.when(cls["isAbstract"], "interface").otherwise("class"), cls["name"], _json(filePath=F.col("path"), startLine=cls["location"]["startLine"], endLine=cls["location"]["endLine"], extends=cls["extends"], implements=cls["implements"]), _at(lit(1), F.col("c")), F.col("path"))
    fn = F.col("fn")
    methods = _node(p["methods"], F.col("nodeId"), lit("function"), fn["name"], _json(filePath=F.col("path"), startLine=fn["location"]["startLine"], isAsync=fn["isAsync"], params=fn["params"]), _at(lit(1), F.col("c"), F.col("m")), F.col("path"))
    functions = _node(p["functions"], F.col("nodeId"), lit("function"), fn["name"], _json(filePath=F.col("path"), startLine=fn["location"]["startLine"], isAsync=fn["isAsync"], isExported=fn["isExported"], params=fn["params"]), _at(lit(2), F.col("f")), F.col("path"))
    outside = p["imports"].where(text.is_external(F.col("imp.source")))
    externals = _node(outside, F.concat(lit("external:"), F.col("imp.source")), lit("external_dependency"), F.col("imp.source"), _json(package=F.col("imp.source")), _at(lit(3), F.col("i")), lit(""))
    return files.unionByName(classes).unionByName(methods).unionByName(functions).unionByName(externals)


def to_edges(parsed: DataFrame) -> DataFrame:
    """Edges with position; targets may dangle. Unresolved parents have ids `<repo>:?:<name>`; the target of a
    relative import is the path exactly as spelled."""
    p = _pieces(parsed)
    cls = F.col("cls")
    contains_class = _edge(p["classes"], "CONTAINS", F.col("fileId"), F.col("classId"), _at(F.lit(1), F.col("c")))
    contains_method = _edge(p["methods"], "CONTAINS", F.col("classId"), F.col("nodeId"), _at(F.lit(1), F.col("c"), F.col("m")))
    contains_function = _edge(p["functions"], "CONTAINS", F.col("fileId"), F.col("nodeId"), _at(F.lit(2), F.col("f")))
    parent = lambda name: F.concat("repositoryId", F.lit(":?:"), name)
    extends = _edge(p["classes"].where(cls["extends"].isNotNull()), "EXTENDS", F.col("classId"), parent(cls["extends"]), _at(F.lit(1), F.col("c")), targetLabel=cls["extends"], unresolved=F.lit(True))
    kinds = p["classes"].select("*", F.posexplode("cls.implements").alias("n", "kind"))
    implements = _edge(kinds, "IMPLEMENTS", F.col("classId"), parent(F.col("kind")), _at(F.lit(1), F.col("c"), F.col("n")), targetLabel=F.col("kind"), unresolved=F.lit(True))
    source = F.col("imp.source")
    target = F.when(text.is_external(source), F.concat(F.lit("external:"), source)).otherwise(F.concat("repositoryId", F.lit(":"), text.resolve_import(F.col("path"), source)))
    imports = _edge(p["imports"], "IMPORTS", F.col("fileId"), target, _at(F.lit(3), F.col("i")), specifiers=F.array_join("imp.specifiers", ","))
    out = contains_class
    for more in (contains_method, contains_function, extends, implements, imports):
        out = out.unionByName(more)
    return out


def number_edges(edges: DataFrame, *more: str) -> DataFrame:
    """Edges, with the columns `more` besides. Edge ids `type:source->target:ordinal`: the ordinal tells equal triples apart, in source order, so that building the
    graph again gives the same ids."""
    same = Window.partitionBy("type", "sourceId", "targetId").orderBy("path", "position")
    return edges.select(F.concat(text.edge_id(F.col("type"), F.col("sourceId"), F.col("targetId")), F.lit(":"), F.row_number().over(same).cast("string")).alias("id"), "sourceId", "targetId", "type", "properties", *more)


def last_wins(nodes: DataFrame, keys: tuple[str, ...] = ("id",), ordinal: str = "ordinal") -> DataFrame:
    """A5: one row for each key, the one with the largest ordinal; map-side combined."""
    rest = [c for c in nodes.columns if c not in keys and c != ordinal]
    best = nodes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("r"))
    return best.select(*(F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in nodes.columns if c != ordinal))


def resolve_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose two ends exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "sourceId"), "sourceId", "left_semi").join(ids.withColumnRenamed("id", "targetId"), "targetId", "left_semi").select(*edges.columns)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that resolve_endpoints() drops, with what is missing."""
    ids = nodes.select(F.col("id").alias("i"), F.lit(True).alias("there")).distinct()
    s = edges.join(ids.select(F.col("i").alias("sourceId"), F.col("there").alias("s")), "sourceId", "left").join(ids.select(F.col("i").alias("targetId"), F.col("there").alias("t")), "targetId", "left")
    return s.where(F.col("s").isNull() | F.col("t").isNull()).select(*edges.columns, F.col("s").isNull().alias("sourceMissing"), F.col("t").isNull().alias("targetMissing"))


def resolve_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """An extension: EXTENDS and IMPLEMENTS edges to the repository's only class or interface of that name; others stay."""
    named = nodes.where(F.col("type").isin("class", "interface")).groupBy("repositoryId", "label").agg(F.min("id").alias("found"), F.count(F.lit(1)).alias("n")).where("n = 1")
    key = named.select(F.concat("repositoryId", F.lit(":?:"), "label").alias("targetId"), "found")
    return edges.join(key, "targetId", "left").withColumn("targetId", F.coalesce("found", "targetId")).select(*edges.columns)


def resolve_extensions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """An extension: a relative import without file extension goes to the first of its candidates that is a file."""
    tries = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".java", "/index.ts", "/index.tsx", "/index.js"]
    imports = edges.where((F.col("type") == "IMPORTS") & ~F.col("targetId").startswith("external:"))
    wide = imports.select("id", F.posexplode(F.array(*(F.concat("targetId", F.lit(t)) for t in tries))).alias("rank", "candidate"))
    hit = wide.join(nodes.select(F.col("id").alias("candidate")).distinct(), "candidate", "left_semi").groupBy("id").agg(F.min_by("candidate", "rank").alias("found"))
    return edges.join(hit, "id", "left").withColumn("targetId", F.coalesce("found", "targetId")).select(*edges.columns)


def root_node(count: DataFrame, repository: str) -> DataFrame:
    """The repository's node; count: one row (n: its files)."""
    name = F.lit(repository)
    return count.select(name.alias("id"), F.lit("repository").alias("type"), name.alias("label"), name.alias("repositoryId"), F.lit("").alias("filePath"), F.to_json(F.struct(F.col("n").alias("fileCount"))).alias("metadataJson"))


def root_edges(parsed: DataFrame, repository: str, *more: str) -> DataFrame:
    """An edge from the repository to each file."""
    name = F.lit(repository)
    return parsed.select(F.concat(F.lit("CONTAINS:"), name, F.lit("->"), F.col("id")).alias("id"), name.alias("sourceId"), F.col("id").alias("targetId"), F.lit("CONTAINS").alias("type"), F.create_map().cast("map<string,string>").alias("properties"), *more).dropDuplicates(["id"])


def build_graph(parsed: DataFrame, repository: str, resolve: bool = False, by_repository: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, warnings) of one repository.

    by_repository: external nodes are kept for each repository; False keeps one for all (the last writer's).
    resolve: also follows parents by name and imports by extension.
    """
    good = parsed.where(has_facts()) if "error" in parsed.columns else parsed
    root = root_node(good.agg(F.count(F.lit(1)).alias("n")), repository)
    nodes = root.unionByName(last_wins(to_nodes(good), ("repositoryId", "id") if by_repository else ("id",)))
    edges = root_edges(good, repository).unionByName(number_edges(to_edges(good)))
    if resolve:
        edges = resolve_extensions(resolve_parents(edges, nodes), nodes)
    return nodes.select(*_NODE), resolve_endpoints(edges, nodes), dangling(edges, nodes)
