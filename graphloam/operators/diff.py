"""Snapshot diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = ["new", "changed", "unchanged", "deleted"]


def snapshot_diff(disk: DataFrame, registry: DataFrame) -> DataFrame:
    """(path, contentHash, bucket) of (path, contentHash) tables, one full outer join. A null hash equals only a null
    hash. Paths are keys of both sides."""
    d, r = disk.select("path", F.col("contentHash").alias("now"), F.lit(True).alias("onDisk")), registry.select("path", F.col("contentHash").alias("then"), F.lit(True).alias("known"))
    both = d.join(r, "path", "full_outer")
    bucket = F.when(F.col("known").isNull(), "new").when(F.col("onDisk").isNull(), "deleted").when(F.col("now").eqNullSafe(F.col("then")), "unchanged").otherwise("changed")
    return both.select("path", F.coalesce("now", "then").alias("contentHash"), bucket.alias("bucket"))


def bucket_counts(diff: DataFrame) -> DataFrame:
    """A10: one row with a count for each bucket."""
    return diff.agg(*(F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS))


def stale_paths(diff: DataFrame) -> DataFrame:
    """U4: what has to go before the new facts come."""
    return diff.where(F.col("bucket").isin("changed", "deleted")).select("path")


def parse_paths(diff: DataFrame) -> DataFrame:
    """U4: what has to be parsed."""
    return diff.where(F.col("bucket").isin("changed", "new")).select("path")
