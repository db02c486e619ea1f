"""Writes as table rewrites: upserts, inserts that skip duplicates, deletes by key. Tables have no enforced keys, so the write
path keeps them; a table is replaced through a staged directory, never in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _first_of(rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    if order is None:
        return rows.dropDuplicates(keys)
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows take the place of old ones with their keys; of several new rows with one key the first by order."""
    new = _first_of(new, keys, order)
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows whose keys are not there yet are added; existing rows stay."""
    fresh = _first_of(new, keys, order).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """By repository and id."""
    return upsert(old, new, ["repositoryId", "id"])


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist and which are not there yet; identity is ends, type and id, properties stay as created."""
    ids = nodes.select("id").distinct()
    ends = new.join(ids.withColumnRenamed("id", "sourceId"), "sourceId", "left_semi").join(ids.withColumnRenamed("id", "targetId"), "targetId", "left_semi")
    return insert_absent(old, ends, ["sourceId", "targetId", "type", "id"])


def delete_for_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame, repository: str, prune_externals: bool = True) -> tuple[DataFrame, DataFrame]:
    """M1: without the nodes of the paths and the edges at them; prune_externals also drops external nodes of the repository
    that nothing imports any more."""
    gone = nodes.where(F.col("repositoryId") == repository).join(paths.select(F.col("path").alias("filePath")).distinct(), "filePath", "left_semi").select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "sourceId"), "sourceId", "left_anti").join(gone.withColumnRenamed("id", "targetId"), "targetId", "left_anti").select(*edges.columns)
    kept = nodes.join(gone.withColumn("repositoryId", F.lit(repository)), ["repositoryId", "id"], "left_anti").select(*nodes.columns)
    if prune_externals:
        external = (F.col("type") == "external_dependency") & (F.col("repositoryId") == repository)
        used = left.select(F.col("targetId").alias("id")).distinct()
        kept = kept.where(~external).unionByName(kept.where(external).join(used, "id", "left_semi").select(*nodes.columns))
    return kept, left


def delete_by_keys(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2, M3: (what is left, one row with the number deleted)."""
    on = keys.columns
    hit = rows.join(keys.distinct(), on, "left_semi")
    return rows.join(keys.distinct(), on, "left_anti").select(*rows.columns), hit.agg(F.count(F.lit(1)).alias("deleted"))


def update_by_key(rows: DataFrame, key: str, value: object, **new: Column | object) -> DataFrame:
    """M4: the columns of one row."""
    to = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.withColumns({c: F.when(F.col(key) == F.lit(value), to(v)).otherwise(F.col(c)).cast(dict(rows.dtypes)[c]) for c, v in new.items()})


def partial_update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Only the defined (non-null) columns of changes take effect."""
    c = changes.select(key, *(F.col(x).alias(f"__{x}") for x in changes.columns if x != key))
    return rows.join(c, key, "left").select(*(F.coalesce(f"__{x}", x).alias(x) if x in changes.columns and x != key else F.col(x) for x in rows.columns))


def soft_delete(rows: DataFrame, key_value: str, now: Column | None = None) -> DataFrame:
    """M5."""
    return update_by_key(rows, "id", key_value, deletedAt=now if now is not None else F.current_timestamp())


def latest_by_key(events: DataFrame, key: str, *order: str) -> DataFrame:
    """M4, T5: the state of each key is its last event; map-side combined."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*(F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in events.columns))


def swap_in(spark: SparkSession, rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """M7: writes all rows beside the table and only then takes its place, so that a failure leaves the old table whole."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target = fs_path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    staged, old = fs_path(f"{path}.new-{uuid.uuid4().hex}"), fs_path(f"{path}.old-{uuid.uuid4().hex}")
    writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
    writer.parquet(staged.toString())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot move the new table to {path}")
    if had:
        fs.delete(old, True)


def stable_id(*parts: Column) -> Column:
    """F32: an id that is the same whenever the row is made again: a hash of what identifies it."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def insert(rows: DataFrame, path: str, id_of: list[str], partition_by: list[str] | None = None) -> None:
    """M6: appends rows with ids from their identifying columns; what has an id keeps it."""
    own = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
    out = rows.withColumn("id", F.coalesce(own, stable_id(*map(F.col, id_of))))
    (out.write.mode("append").partitionBy(*partition_by) if partition_by else out.write.mode("append")).parquet(path)
