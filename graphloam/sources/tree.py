"""Source trees as tables: directories, ZIP archives, and the store of parsed files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.functions import text
from graphloam.schemas import PARSED_FILE

# What a scan leaves out.
IGNORED_DIRECTORIES = ["node_modules", ".git", "dist", "__pycache__"]
IGNORED_SUFFIXES = [".class"]

FILES = "repositoryId string, path string, bytes binary, content string, contentHash string"


def wanted(path: Column, any_depth: bool = False) -> Column:
    """Not below an ignored directory (at the root, or at any depth), no hidden segment, no ignored suffix."""
    head = "(^|/)" if any_depth else "^"
    ignored = head + "(" + "|".join(d.replace(".", "\\.") for d in IGNORED_DIRECTORIES) + ")/"
    return ~path.rlike(ignored) & ~path.rlike("(^|/)\\.") & ~path.rlike("(" + "|".join(s.replace(".", "\\.") for s in IGNORED_SUFFIXES) + ")$")


def _as_files(rows: DataFrame, repository: str) -> DataFrame:
    """Content is null for bytes that are no UTF-8; hashes are of the bytes, for registry and disk alike."""
    return rows.select(F.lit(repository).alias("repositoryId"), "path", "bytes", F.when(F.is_valid_utf8("bytes"), F.decode("bytes", "UTF-8")).alias("content"), text.content_hash(F.col("bytes")).alias("contentHash"))


def scan_tree(spark: SparkSession, root: str, repository: str, languages_only: bool = False, any_depth: bool = False) -> DataFrame:
    """The files below root as FILES, with paths relative to it."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    bare = F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "")
    rows = found.select(F.substring(bare, F.lit(len(_bare(base)) + 2), F.length(bare)).alias("path"), F.col("content").alias("bytes")).where(wanted(F.col("path"), any_depth))
    return _as_files(rows.where(text.is_supported(F.col("path"))) if languages_only else rows, repository)


def _bare(path: str) -> str:
    return "/" + path.split("://", 1)[-1].lstrip("/") if "://" in path else path.removeprefix("file:")


def scan_zip(spark: SparkSession, archive: str, repository: str, any_depth: bool = False) -> DataFrame:
    """S3: the files of a ZIP archive as FILES; a single top directory is unwrapped. An archive is unpacked by one task, a file
    of it at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    tops = {n.split("/", 1)[0] for n in names}
                    cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in n for n in names) else 0
                    for n in names:
                        yield pa.RecordBatch.from_arrays([pa.array([n[cut:]]), pa.array([z.read(n)], pa.binary())], names=["path", "bytes"])

    rows = spark.read.format("binaryFile").load(archive).select("content").mapInArrow(run, "path string, bytes binary")
    return _as_files(rows.where(wanted(F.col("path"), any_depth)), repository)


def languages(files: DataFrame) -> DataFrame:
    """(repositoryId, languages): the known languages, sorted."""
    return files.groupBy("repositoryId").agg(F.sort_array(F.collect_set(text.language(F.col("path")))).alias("languages"))


def write_parsed(parsed: DataFrame, path: str, pretty_json: bool = False) -> None:
    """As Parquet by repository; pretty_json adds a column with the AST's file name and its facts as indented JSON."""
    out = parsed
    if pretty_json:
        body = F.to_json(F.struct(*(c for c in parsed.columns if c not in ("error",))), {"pretty": "true"})
        out = parsed.withColumn("astName", F.concat(text.ast_name(F.col("path")), F.lit(".json"))).withColumn("astJson", body)
    out.write.mode("append").partitionBy("repositoryId").parquet(path)


def read_parsed(spark: SparkSession, path: str, repository: str | None = None, file: str | None = None) -> DataFrame:
    """Parsed files; an absent file gives no rows."""
    out = spark.read.schema(PARSED_FILE).parquet(path)
    out = out.where(F.col("repositoryId") == repository) if repository is not None else out
    return out.where(F.col("path") == file) if file is not None else out
