"""Chunks of source text for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloam.functions import text


def chunk(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """A chunk for each function, class preview and method, or for the whole file if it has neither function nor class.

    files: (repositoryId, path, content). Files without content give no chunks. nodeId is the id of the graph's node; the
    chunk's id is a hash of repository, node and position, so that building again gives the same ids. Wide text is joined
    once; each kind explodes its own facts.
    """
    body = files.where("content is not null").select("repositoryId", "path", "content")
    rows = parsed.join(body, ["repositoryId", "path"])
    fn, cls = F.col("fn"), F.col("cls")

    def out(df: DataFrame, node_id, kind: str, name, start, end, position):  # noqa: ANN001
        return df.select("repositoryId", node_id.alias("nodeId"), F.col("path").alias("filePath"), F.lit(kind).alias("nodeType"), name.alias("name"), text.line_slice(F.col("content"), start, end).alias("content"), start.cast("int").alias("startLine"), end.cast("int").alias("endLine"), position.alias("position"))

    at = lambda *p: F.array(*(x.cast("int") for x in p))
    functions = rows.select("repositoryId", "path", "id", "content", F.posexplode("functions").alias("f", "fn"))
    one = out(functions, F.concat("id", F.lit("#"), fn["name"]), "function", fn["name"], fn["location"]["startLine"], fn["location"]["endLine"], at(F.lit(0), F.col("f")))
    classes = rows.select("repositoryId", "path", "id", "content", F.posexplode("classes").alias("c", "cls"))
    place = cls["location"]
    two = out(classes, F.concat("id", F.lit("#"), cls["name"]), "class", cls["name"], place["startLine"], text.class_preview_end(place["startLine"], place["endLine"]), at(F.lit(1), F.col("c"), F.lit(-1)))
    methods = classes.select("repositoryId", "path", "id", "content", "c", cls["name"].alias("owner"), F.posexplode("cls.methods").alias("m", "fn"))
    three = out(methods, F.concat("id", F.lit("#"), F.col("owner"), F.lit("#"), fn["name"]), "method", F.concat("owner", F.lit("."), fn["name"]), fn["location"]["startLine"], fn["location"]["endLine"], at(F.lit(1), F.col("c"), F.col("m")))
    whole = rows.where((F.size("functions") == 0) & (F.size("classes") == 0))
    head = text.file_preview(F.col("content"))
    four = whole.select("repositoryId", F.col("id").alias("nodeId"), F.col("path").alias("filePath"), F.lit("file").alias("nodeType"), text.basename(F.col("path")).alias("name"), head.alias("content"), F.lit(1).alias("startLine"), text.line_count(head).alias("endLine"), at(F.lit(0)).alias("position"))
    rows_out = one.unionByName(two).unionByName(three).unionByName(four)
    return rows_out.select(F.sha2(F.concat_ws("|", "repositoryId", "nodeId", F.array_join(F.col("position").cast("array<string>"), ".")), 256).alias("id"), *[c for c in rows_out.columns if c != "position"], F.lit(None).cast("array<float>").alias("embedding"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """A4: (repositoryId, n)."""
    return chunks.groupBy("repositoryId").agg(F.count(F.lit(1)).alias("n"))


def store_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks and vectors in one write, by repository."""
    chunks.write.mode("append").partitionBy("repositoryId").parquet(path)
