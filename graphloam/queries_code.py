"""Queries of the chain from source files to a graph and chunks, over the rendered sources."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.functions import text
from graphloam.operators import chunks as chunking
from graphloam.operators import extract, graph_build, layout, metrics, vectors
from graphloam.plans.durable import Tables
from graphloam.plans.incremental import GraphStore
from graphloam.plans.rendered import PIECES_SQL, SOURCES_SQL, pieces, sources
from graphloam.queries import _read, query
from graphloam.sources import pr_files, tree
from graphloam.sources.paged import SCHEMA, PagedFiles

#: What stands in the rendered sources: (kind of file, what, owner, name, detail, first line, last line).
FACTS_SQL = (
    SOURCES_SQL
    + r""",
shape(kind, what, owner, name, detail, first, last) AS (VALUES
  (0, 'import', '', '@nestjs/common', 'Injectable', 0, 0), (0, 'import', '', './base@b.ts', 'Base', 0, 0), (0, 'export', '', 'Part@k', 'false', 0, 0), (0, 'export', '', 'make@k', 'false', 0, 0),
  (0, 'class', '', 'Part@k', 'Base|Kind,Sized|false', 4, 9), (0, 'method', 'Part@k', 'price', 'q: number|Promise<number>|true|false', 5, 7), (0, 'method', 'Part@k', 'size', '||false|false', 8, 8),
  (0, 'function', '', 'make@k', 'x: number|Part@k|false|true', 10, 12), (0, 'hint', '', 'nestjs', '@nestjs import detected', 0, 0),
  (1, 'import', '', 'express', 'express', 0, 0), (1, 'import', '', '../src/base@b.ts', 'shared', 0, 0), (1, 'export', '', 'main@k', 'true', 0, 0),
  (1, 'function', '', 'helper@k', 'a,b||false|false', 3, 5), (1, 'function', '', 'main@k', '||false|true', 6, 8), (1, 'hint', '', 'express', 'express import detected', 0, 0),
  (2, 'import', '', 'org.springframework.stereotype.Service', 'Service', 0, 0), (2, 'class', '', 'Part@k', 'Base|Kind|true', 4, 8), (2, 'method', 'Part@k', 'price', 'int q,String s|int|false|true', 5, 7),
  (2, 'hint', '', 'spring', 'Spring import detected', 0, 0), (2, 'hint', '', 'spring', 'Spring Service', 0, 0),
  (3, 'import', '', 'os', 'os', 0, 0), (3, 'import', '', '.base@b', 'Base', 0, 0), (3, 'class', '', 'Part@k', 'Base|Kind|false', 3, 5), (3, 'method', 'Part@k', 'price', 'self,q|int|false|true', 4, 5),
  (3, 'function', '', 'make@k', 'x,*rest||true|true', 7, 8), (4, 'export', '', 'base@b', 'false', 0, 0), (4, 'export', '', 'other', 'false', 0, 0)),
fact AS (SELECT repo, kind, fid, path, content, what, replace(replace(owner, '@k', k::VARCHAR), '@b', b::VARCHAR) AS owner, replace(replace(name, '@k', k::VARCHAR), '@b', b::VARCHAR) AS name,
  replace(detail, '@k', k::VARCHAR) AS detail, first, last FROM src JOIN shape USING (kind))"""
)
LANGUAGE_SQL = "(['typescript', 'javascript', 'java', 'python', 'typescript'])[(kind + 1)::INTEGER]"
BASENAME_SQL = "split_part(path, '/', 2)"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.parse(sources(spark, sf_dir))


def _stored(spark: SparkSession, parsed: DataFrame) -> DataFrame:
    """Parsed files as a table, so that what reads them several times does not parse them again."""
    return Tables(spark).write(parsed)


@query(FACTS_SQL + """ SELECT repo AS "repositoryId", path, what, owner, name, detail, first, last FROM fact""")
def parsed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact of every file, flattened."""
    return _flat(_parsed(spark, sf_dir).where("error is null"))


def _flat(p: DataFrame) -> DataFrame:
    """A row for every fact, from one pass over the files."""
    none, zero = F.lit(""), F.lit(0)

    def row(what: str, owner, name, detail, place=None):  # noqa: ANN001, ANN202
        first, last = (zero, zero) if place is None else (place["startLine"], place["endLine"])
        return F.struct(F.lit(what).alias("what"), owner.alias("owner"), name.alias("name"), F.coalesce(detail, none).alias("detail"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    def call(what: str, owner, f):  # noqa: ANN001, ANN202
        return row(what, owner, f["name"], F.concat_ws("|", F.array_join(f["params"], ","), F.coalesce(f["returnType"], none), f["isAsync"].cast("string"), f["isExported"].cast("string")), f["location"])

    facts = F.concat(
        F.transform("imports", lambda x: row("import", none, x["source"], F.array_join(x["specifiers"], ","))), F.transform("exports", lambda x: row("export", none, x["name"], x["isDefault"].cast("string"))),
        F.transform("classes", lambda x: row("class", none, x["name"], F.concat_ws("|", F.coalesce(x["extends"], none), F.array_join(x["implements"], ","), x["isAbstract"].cast("string")), x["location"])),
        F.flatten(F.transform("classes", lambda c: F.transform(c["methods"], lambda x: call("method", c["name"], x)))), F.transform("functions", lambda x: call("function", none, x)),
        F.transform("frameworkHints", lambda x: row("hint", none, x["framework"], x["hint"])),
    )
    return p.select("repositoryId", "path", F.inline(facts))


@query(PIECES_SQL)
def scanned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in files that are made of pieces: regular expressions after conditions and blocks, divisions, nested
    templates, type lists and elements, in a thousand combinations."""
    return _flat(extract.parse(pieces(spark, sf_dir))).select("path", "what", "owner", "name", "first", "last")


@query(
    FACTS_SQL
    + f""" SELECT fid AS id, {LANGUAGE_SQL} AS language, sha256(content) AS "contentHash", count(*) FILTER (what = 'import')::INTEGER AS "importCount", count(*) FILTER (what = 'export')::INTEGER AS "exportCount",
  count(*) FILTER (what = 'class')::INTEGER AS "classCount", count(*) FILTER (what = 'function')::INTEGER AS "functionCount", '1.0.0' AS "parserVersion" FROM fact GROUP BY fid, kind, content"""
)
def parsed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return metrics.parsed_summary(_parsed(spark, sf_dir)).select("id", "language", "contentHash", "importCount", "exportCount", "classCount", "functionCount", "parserVersion")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Unbalanced' WHEN 1 THEN 'SyntaxError' ELSE '' END AS error FROM part")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be parsed are rows that say so."""
    k = F.col("p_partkey")
    body = F.when(k % 3 == 0, "class A { m() {").when(k % 3 == 1, "def f(:").otherwise("class B { m() { return /`/ } }")
    ext = F.when(k % 3 == 1, ".py").otherwise(".ts")
    files = _read(spark, sf_dir, "part").select(F.lit("r").alias("repositoryId"), F.concat(k.cast("string"), ext).alias("path"), body.alias("content"), F.lit("").alias("contentHash"))
    out = extract.parse(files)
    return out.select(F.regexp_extract("path", "^[0-9]+", 0).cast("long").alias("p_partkey"), F.regexp_extract(F.coalesce("error", F.lit("")), "^[A-Za-z]*", 0).alias("error"))


# ---------------------------------------------------------------------------------------------------------------- graph

_PARAMS = """'[' || CASE WHEN split_part(detail, '|', 1) = '' THEN '' ELSE '"' || replace(split_part(detail, '|', 1), ',', '","') || '"' END || ']'"""
_BUILT_SQL = (
    FACTS_SQL
    + f""",
f0 AS (SELECT * FROM fact WHERE repo = 'r0'), s0 AS (SELECT * FROM src WHERE repo = 'r0'),
node AS (
  SELECT 'r0' AS id, 'repository' AS type, 'r0' AS label, '' AS "filePath", '{{"fileCount":' || count(*) || '}}' AS "metadataJson" FROM s0
  UNION ALL SELECT fid, CASE WHEN kind IN (0, 2) THEN 'service' ELSE 'file' END, {BASENAME_SQL}, path, '{{"path":"' || path || '","language":"' || {LANGUAGE_SQL} || '","contentHash":"' || sha256(content) || '"}}' FROM s0
  UNION ALL SELECT fid || '#' || name, CASE WHEN kind = 2 THEN 'interface' ELSE 'class' END, name, path, '{{"filePath":"' || path || '","startLine":' || first || ',"endLine":' || last || ',"extends":"Base","implements":["' || replace(split_part(detail, '|', 2), ',', '","') || '"]}}' FROM f0 WHERE what = 'class'
  UNION ALL SELECT fid || '#' || owner || '#' || name, 'function', name, path, '{{"filePath":"' || path || '","startLine":' || first || ',"isAsync":' || split_part(detail, '|', 3) || ',"params":' || {_PARAMS} || '}}' FROM f0 WHERE what = 'method'
  UNION ALL SELECT fid || '#' || name, 'function', name, path, '{{"filePath":"' || path || '","startLine":' || first || ',"isAsync":' || split_part(detail, '|', 3) || ',"isExported":' || split_part(detail, '|', 4) || ',"params":' || {_PARAMS} || '}}' FROM f0 WHERE what = 'function'
  UNION ALL SELECT DISTINCT 'external:' || name, 'external_dependency', name, '', '{{"package":"' || name || '"}}' FROM f0 WHERE what = 'import' AND left(name, 1) NOT IN ('.', '/')),
edge0 AS (
  SELECT 'CONTAINS' AS type, 'r0' AS s, fid AS t, '' AS n, '{{}}' AS properties FROM s0
  UNION ALL SELECT 'CONTAINS', fid, fid || '#' || name, ':1', '{{}}' FROM f0 WHERE what IN ('class', 'function')
  UNION ALL SELECT 'CONTAINS', fid || '#' || owner, fid || '#' || owner || '#' || name, ':1', '{{}}' FROM f0 WHERE what = 'method'
  UNION ALL SELECT 'EXTENDS', fid || '#' || name, 'r0:?:Base', ':1', '{{"targetLabel":"Base","unresolved":"true"}}' FROM f0 WHERE what = 'class'
  UNION ALL SELECT 'IMPLEMENTS', fid || '#' || name, 'r0:?:' || i, ':1', '{{"targetLabel":"' || i || '","unresolved":"true"}}' FROM (SELECT fid, name, unnest(string_split(split_part(detail, '|', 2), ',')) AS i FROM f0 WHERE what = 'class')
  UNION ALL SELECT 'IMPORTS', fid, CASE WHEN left(name, 1) NOT IN ('.', '/') THEN 'external:' || name WHEN left(name, 1) = '.' AND substr(name, 2, 1) NOT IN ('.', '/') THEN 'r0:src/' || name ELSE 'r0:src/' || split_part(name, '/', -1) END, ':1', '{{"specifiers":"' || detail || '"}}' FROM f0 WHERE what = 'import'),
edge AS (SELECT type || ':' || s || '->' || t || n AS id, s AS "sourceId", t AS "targetId", type, properties, s IN (SELECT id FROM node) AND t IN (SELECT id FROM node) AS there FROM edge0)"""
)


def _built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return graph_build.build_graph(_stored(spark, extract.parse(sources(spark, sf_dir).where("repositoryId = 'r0'"))), "r0")


@query(_BUILT_SQL + """ SELECT id, type, label, 'r0' AS "repositoryId", "filePath", "metadataJson" FROM node""")
def built_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a repository."""
    return _built(spark, sf_dir)[0]


@query(_BUILT_SQL + """ SELECT id, "sourceId", "targetId", type, properties FROM edge WHERE there""")
def built_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its edges, whose two ends exist."""
    return _built(spark, sf_dir)[1].withColumn("properties", F.to_json("properties"))


@query(
    _BUILT_SQL
    + f""", fresh AS (SELECT fid, (kind = 4 AND b = 3) OR (kind <> 4 AND k % 11 = 0) AS new, kind <> 4 AND k % 13 = 0 AS changed, kind IN (0, 1) AND b = 3 AS importer FROM s0),
own AS (SELECT *, split_part(CASE WHEN s = 'r0' THEN t ELSE s END, '#', 1) AS fid FROM edge0)
SELECT 'node' AS what, id AS name, 1 AS n FROM node UNION ALL SELECT 'edge', id, 1 FROM edge WHERE there
UNION ALL SELECT 'written', 'parsed', count(*) FILTER (new OR changed)::INTEGER FROM fresh
UNION ALL SELECT 'written', 'nodes', count(*)::INTEGER FROM node JOIN fresh ON split_part(id, '#', 1) = fid WHERE new OR changed
UNION ALL SELECT 'written', 'edges', count(*)::INTEGER FROM own JOIN fresh USING (fid) WHERE new OR changed OR importer"""
)
def incremental_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository's graph after an ingestion that meets new and changed files, one of which others import already; and the
    rows that this delta wrote: those of these files, and the edges of the importers."""
    with Tables(spark) as work:
        keep = Tables(spark)
        store = GraphStore(spark, work.folder(), "r0")
        now = work.write(sources(spark, sf_dir).where("repositoryId = 'r0'"))
        k = F.regexp_extract("path", "(?i)part([0-9]+)", 1)
        number = F.when(k != "", k.cast("long"))
        before = now.where((F.coalesce(number, F.lit(1)) % 11 != 0) & (F.col("path") != "src/base3.ts"))
        body = F.when(number % 13 == 0, F.concat("content", F.lit("\n"))).otherwise(F.col("content"))
        store.ingest(before.withColumn("content", body).withColumn("contentHash", text.content_hash(F.col("content"))))
        written = store.ingest(now)["written"]
        rows = [("written", t, written[t]) for t in ("parsed", "nodes", "edges")]
        parts = (store.nodes().select(F.lit("node").alias("what"), F.col("id").alias("name"), F.lit(1).alias("n")), store.edges().select(F.lit("edge").alias("what"), F.col("id").alias("name"), F.lit(1).alias("n")))
        return keep.write(parts[0].unionByName(parts[1]).unionByName(spark.createDataFrame(rows, "what string, name string, n int")))


@query(_BUILT_SQL + """ SELECT id, "sourceId", "targetId", type, properties, true AS "targetMissing" FROM edge WHERE NOT there""")
def dropped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that were left out."""
    return _built(spark, sf_dir)[2].where("not sourceMissing").withColumn("properties", F.to_json("properties")).drop("sourceMissing")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'module' WHEN 3 THEN 'service' WHEN 4 THEN 'file' ELSE 'file' END AS type FROM part")
def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """by suffix, then by hint."""
    k = F.col("p_partkey")
    path = F.element_at(F.array(*map(F.lit, ["a/x.controller.ts", "a/x.service.js", "a/b/x.module.ts", "a/x.ts", "controller.ts", "a/x.service.tsx"])), (k % 6 + 1).cast("int"))
    hints = F.when(k % 6 == 3, text.framework_hints(F.lit("typescript"), F.lit("import '@nestjs/core'"))).when(k % 6 == 4, text.framework_hints(F.lit("typescript"), F.lit("import 'express'")))
    return _read(spark, sf_dir, "part").select("p_partkey", text.node_type(path, hints).alias("type"))


@query(
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'nestjs:@nestjs import detected' WHEN 1 THEN 'angular:@angular import detected' WHEN 2 THEN 'react:react import detected' WHEN 3 THEN 'express:express import detected'
  WHEN 4 THEN 'fastapi:FastAPI detected,flask:Flask detected,django:Django detected' WHEN 5 THEN 'spring:Spring import detected,spring:Spring Controller,spring:Spring Service' WHEN 6 THEN 'react:react import detected' ELSE '' END AS hints FROM part"""
)
def framework_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24."""
    k = (F.col("p_partkey") % 8 + 1).cast("int")
    lang = F.element_at(F.array(*map(F.lit, ["typescript"] * 4 + ["python", "java", "javascript", "typescript"])), k)
    source = F.element_at(F.array(*map(F.lit, ["from '@nestjs/x'", "from '@angular/core'", "from 'react'", "express()", "FastAPI Flask django express", "springframework @RestController @Service", 'from "react"', "fastapi springframework"])), k)
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(text.framework_hints(lang, source), lambda h: F.concat(h["framework"], F.lit(":"), h["hint"])), ",").alias("hints"))


@query("""SELECT s_suppkey, 'USES:s' || s_suppkey || '->n' || s_nationkey AS id FROM supplier""")
def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25."""
    at = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return _read(spark, sf_dir, "supplier").select("s_suppkey", text.edge_id(F.lit("USES"), at("s", "s_suppkey"), at("n", "s_nationkey")).alias("id"))


# --------------------------------------------------------------------------------------------------------------- chunks

_CHUNK_SQL = (
    FACTS_SQL
    + f""",
piece AS (SELECT repo, path, fid || '#' || name AS node, 'function' AS kind_of, name, first AS a, last AS z, content FROM fact WHERE what = 'function'
  UNION ALL SELECT repo, path, fid || '#' || name, 'class', name, first, least(first + 10, last), content FROM fact WHERE what = 'class'
  UNION ALL SELECT repo, path, fid || '#' || owner || '#' || name, 'method', owner || '.' || name, first, last, content FROM fact WHERE what = 'method'
  UNION ALL SELECT repo, path, fid, 'file', {BASENAME_SQL}, 1, 3, content FROM src WHERE kind = 4),
chunk AS (SELECT repo AS "repositoryId", node AS "nodeId", path AS "filePath", kind_of AS "nodeType", name, left(array_to_string(string_split(content, chr(10))[a:z], chr(10)), 2000) AS content, a::INTEGER AS "startLine", z::INTEGER AS "endLine" FROM piece)"""
)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sources(spark, sf_dir)
    return chunking.chunk(_stored(spark, extract.parse(files)), files)


@query(_CHUNK_SQL + " SELECT * FROM chunk")
def built_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all files."""
    return _chunks(spark, sf_dir).drop("id", "embedding")


@query(_CHUNK_SQL + """ SELECT "repositoryId", count(*)::BIGINT AS n, count(DISTINCT "nodeId")::BIGINT AS ids FROM chunk GROUP BY "repositoryId\"""")
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written by repository and read again; their ids are unique."""
    path = Tables(spark).folder()
    chunks = _chunks(spark, sf_dir)
    chunking.store_chunks(chunks, path)
    stored = spark.read.schema(chunks.schema).parquet(path)
    return chunking.chunk_counts(stored).join(stored.groupBy("repositoryId").agg(F.countDistinct("id").alias("ids")), "repositoryId")


@query(_CHUNK_SQL + """ SELECT "repositoryId", count(*)::BIGINT AS n FROM chunk GROUP BY "repositoryId\"""")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return chunking.chunk_counts(_chunks(spark, sf_dir))


def measured(texts: list[str]) -> list[list[float]]:
    """An embedding that SQL can give as well: length, number of letters e, 1."""
    return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]


@query(_CHUNK_SQL + """ SELECT "nodeId", "nodeType", length(t)::DOUBLE AS size, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS e, 1::DOUBLE AS one FROM (SELECT *, name || chr(10) || content AS t FROM chunk)""")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the vectors of a provider, ten texts at a time."""
    out = vectors.embed_chunks(_chunks(spark, sf_dir), measured, 3)
    return out.select("nodeId", "nodeType", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("size", "e", "one"))))


@query("SELECT p_partkey, least(p_size + 10, p_size + p_partkey % 20)::BIGINT AS end_line, p_name || chr(10) || p_type AS embed FROM part")
def chunk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, F22."""
    return _read(spark, sf_dir, "part").select("p_partkey", text.class_preview_end(F.col("p_size").cast("long"), F.col("p_size") + F.col("p_partkey") % 20).alias("end_line"), text.embed_text(F.col("p_name"), F.col("p_type")).alias("embed"))


# -------------------------------------------------------------------------------------------------------------- sources


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()


_TREE_PATHS = ["src/@.ts", "node_modules/@.js", "lib/.hidden/@.py", "docs/@.md", "deep/dist/@.java"]
_TREE_SQL = "WITH t AS (SELECT n_nationkey % 5 AS m, replace((['src/@.ts', 'node_modules/@.js', 'lib/.hidden/@.py', 'docs/@.md', 'deep/dist/@.java'])[n_nationkey % 5 + 1], '@', n_name) AS path, n_name || chr(10) || n_regionkey AS content FROM nation)"


@query(
    _TREE_SQL
    + """ SELECT 'all' AS scope, path, content, sha256(content) AS "contentHash" FROM t WHERE m NOT IN (1, 2)
  UNION ALL SELECT 'languages', path, content, sha256(content) FROM t WHERE m = 0"""
)
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory with ignored and hidden ones, whole and by language."""
    root = Tables(spark).folder()
    for r in _read(spark, sf_dir, "nation").collect():  # the fixture: 25 small files
        _put(spark, f"{root}/{_TREE_PATHS[r['n_nationkey'] % 5].replace('@', r['n_name'])}", f"{r['n_name']}\n{r['n_regionkey']}".encode())
    one = tree.scan_tree(spark, root, "r").withColumn("scope", F.lit("all"))
    two = tree.scan_tree(spark, root, "r", languages_only=True, any_depth=True).withColumn("scope", F.lit("languages"))
    return one.unionByName(two).select("scope", "path", "content", "contentHash")


@query(_TREE_SQL + " SELECT path, content FROM t WHERE m NOT IN (1, 2)")
def zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: an archive whose single top directory is unwrapped."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for r in _read(spark, sf_dir, "nation").collect():
            z.writestr(f"top-main/{_TREE_PATHS[r['n_nationkey'] % 5].replace('@', r['n_name'])}", f"{r['n_name']}\n{r['n_regionkey']}")
    path = Tables(spark).folder() + "/main.zip"
    _put(spark, path, buffer.getvalue())
    return tree.scan_zip(spark, path, "r").select("path", "content")


@query(
    FACTS_SQL
    + f""" SELECT path, {LANGUAGE_SQL} AS language, (count(*) FILTER (what = 'export'))::INTEGER AS exports, replace(path, '/', '-') || '.json' AS "astName", true AS same FROM fact WHERE repo = 'r1' GROUP BY path, kind"""
)
def parsed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed files stored by repository, one repository read again, and the stored JSON."""
    path = Tables(spark).folder()
    tree.write_parsed(_parsed(spark, sf_dir), path, pretty_json=True)
    json = spark.read.parquet(path).where("repositoryId = 'r1'").select("path", "astName", (F.get_json_object("astJson", "$.path") == F.col("path")).alias("same"))
    return tree.read_parsed(spark, path, "r1").select("path", "language", F.size("exports").alias("exports")).join(json, "path")


@query("""SELECT c_nationkey + 1 AS page, 'c' || c_custkey AS filename, CASE WHEN c_custkey % 3 = 0 THEN 'removed' ELSE 'added' END AS status, c_nationkey < 12 AS batch FROM customer""")
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of files through the data source: the first twelve as a batch, the others as a stream that begins behind
    them."""
    spark.dataSource.register(PagedFiles)
    base = Tables(spark).folder()
    status = F.when(F.col("c_custkey") % 3 == 0, "removed").otherwise("added")
    pages = _read(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") + 1).alias("page")).agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("filename"), status.alias("status")))).alias("value"))
    pages.repartition("page").write.partitionBy("page").text(f"{base}/pages")
    url = f"{base}/pages/page={{page}}/part-*"
    first = spark.read.format("paged_files").option("url", url).option("pages", 12).load().withColumn("batch", F.lit(True))
    stream = spark.readStream.format("paged_files").option("url", url).option("from", 13).load()
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return first.unionByName(spark.read.schema(SCHEMA).parquet(f"{base}/out").withColumn("batch", F.lit(False)))


@query(
    """SELECT filename, min(status) AS status, filename NOT LIKE '%removed%' AS changed FROM (SELECT 'c/' || CASE WHEN c_custkey % 3 = 0 THEN 'removed' ELSE 'kept' END || c_custkey AS filename, CASE WHEN c_custkey % 3 = 0 THEN 'removed' WHEN c_custkey % 3 = 1 THEN 'added' ELSE 'modified' END AS status FROM customer WHERE c_custkey % 7 <> 0) GROUP BY filename"""
)
def pr_file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a pull request's files and comparisons, stored one response a file; files of unknown state are
    left out, and `changed` are those that are not removed."""
    from graphloam.operators import impact

    k = F.col("c_custkey")
    status = F.when(k % 7 == 0, "strange").when(k % 3 == 0, "removed").when(k % 3 == 1, "added").otherwise("modified")
    name = F.concat(F.lit("c/"), F.when(k % 3 == 0, "removed").otherwise("kept"), k.cast("string"))
    files = F.sort_array(F.collect_list(F.struct(name.alias("filename"), status.alias("status"))))
    pages = _read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(files.alias("files"))
    base = Tables(spark).folder()
    pages.where("c_nationkey < 12").select("c_nationkey", F.to_json("files").alias("value")).repartition("c_nationkey").write.mode("overwrite").partitionBy("c_nationkey").text(f"{base}/pages")
    pages.where("c_nationkey >= 12").select("c_nationkey", F.to_json(F.struct("files")).alias("value")).repartition("c_nationkey").write.mode("overwrite").partitionBy("c_nationkey").text(f"{base}/comparisons")
    out = pr_files.from_files_pages(spark, f"{base}/pages").unionByName(pr_files.from_comparisons(spark, f"{base}/comparisons"))
    kept = impact.changed_files(out.select("filename", "status")).withColumn("kept", F.lit(True))
    return out.join(kept, F.col("filename") == kept["path"], "left").select("filename", "status", F.coalesce("kept", F.lit(False)).alias("changed"))


# --------------------------------------------------------------------------------------------------------------- layout


@query("SELECT n_nationkey, ((n_nationkey % 10) * 220)::DOUBLE AS x, ((n_nationkey // 10) * 120)::DOUBLE AS y FROM nation")
def layout_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F31."""
    at = layout.grid(F.col("n_nationkey"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", at["x"].alias("x"), at["y"].alias("y"))


@query("SELECT r_name AS \"repositoryId\", count(*)::BIGINT AS nodes, true AS centred, true AS apart FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def layout_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node has a place; the layout is centred and its nodes are apart."""
    n = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = n.select(F.col("r_name").alias("repositoryId"), F.col("n_name").alias("id"))
    edges = nodes.alias("a").join(nodes.alias("b"), (F.col("a.repositoryId") == F.col("b.repositoryId")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("sourceId"), F.col("b.id").alias("targetId"))
    out = layout.force_layout(nodes, edges)
    far = F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)) > 20
    return out.groupBy("repositoryId").agg(F.count(F.lit(1)).alias("nodes"), ((F.abs(F.avg("x")) < 1e-6) & (F.abs(F.avg("y")) < 1e-6)).alias("centred"), far.alias("apart"))
