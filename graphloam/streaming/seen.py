"""Ids that a stream has seen, forever, so that a micro-batch reads a bounded part of them.

An id's hash begins with hex digits; the first `depth` of them name its bucket. When buckets hold more than BUCKET_ROWS ids on
average, all are dealt again by one digit more, so a batch of n ids reads n buckets of bounded size, however long the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.plans.versions import Versions

SCHEMA = {"seen": "id string, batch long, bucket string"}
#: Ids of a bucket on average, at most; additions after which a bucket's files are put together.
BUCKET_ROWS, ADDITIONS = 100_000, 32


class SeenIds:
    """Hashes (64 hex digits) in a folder, with the number of the batch that brought them."""

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS, additions: int = ADDITIONS) -> None:
        self.spark, self.versions = spark, Versions(spark, path, SCHEMA)
        self.bucket_rows, self.additions = bucket_rows, additions

    def _notes(self) -> dict:
        return {"depth": 0, "rows": 0} | self.versions.manifest()["notes"]

    def among(self, ids: DataFrame, batch: int) -> DataFrame:
        """Those of ids (id) that another batch has brought. The buckets of the ids are read; their names come to the driver, as
        many as there are ids or buckets at most."""
        depth = self._notes()["depth"]
        rows = self.versions.read("seen").where(F.col("batch") != batch)
        if depth:
            buckets = [r[0] for r in ids.where("id is not null").select(F.substring("id", 1, depth)).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        return ids.select("id").distinct().join(rows.select("id"), "id", "left_semi")

    def add(self, ids: DataFrame, batch: int) -> None:
        """A batch that is repeated adds its ids again, which changes nothing."""
        change, notes = self.versions.begin(), self._notes()
        new = ids.select("id", F.lit(batch).cast("long").alias("batch")).distinct()
        notes["rows"] += new.count()
        depth = notes["depth"]
        while notes["rows"] > self.bucket_rows * 16**depth:
            depth += 1
        placed = lambda rows: rows.withColumn("bucket", F.substring("id", 1, depth) if depth else F.lit("all"))
        if depth != notes["depth"] or len(change.tables.get("seen", [])) >= self.additions:
            whole = self.versions.read("seen").select("id", "batch").unionByName(new).groupBy("id").agg(F.min("batch").alias("batch"))
            change.replace("seen", placed(whole).repartition("bucket"), by="bucket")
        else:
            change.add("seen", placed(new).repartition("bucket"), by="bucket")
        change.notes |= {"depth": depth, "rows": notes["rows"]}
        change.commit()
        self.versions.vacuum()
