"""Files of pull requests and commit comparisons, from stored REST responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "struct<filename:string,status:string>"

# The states of a file.
STATUS = ["added", "removed", "modified", "renamed", "copied", "changed", "unchanged"]


def from_files_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source, filename, status) of responses that are arrays of files, one page a document; all pages in path count, so
    there is no cap of a first page."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.from_json("value", f"array<{FILE}>").alias("files"))
    return _rows(pages)


def from_comparisons(spark: SparkSession, path: str) -> DataFrame:
    """Of commit comparisons, whose files may be absent."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.from_json("value", f"struct<files:array<{FILE}>>")["files"].alias("files"))
    return _rows(pages)


def _rows(pages: DataFrame) -> DataFrame:
    out = pages.select("source", F.explode(F.coalesce("files", F.array().cast(f"array<{FILE}>"))).alias("f")).select("source", "f.filename", "f.status")
    return out.where(F.col("filename").isNotNull() & F.col("status").isin(STATUS)).dropDuplicates(["filename"])
