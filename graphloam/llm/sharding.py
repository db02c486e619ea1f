"""Sharding by fixed virtual slots.

Every record hashes into one of some thousands of virtual slots, once and for ever. The bytes of each slot are summed, and
a versioned map gives every slot a shard. Rebalancing edits the map alone: records never change their slot, and a new
version says which slots moved. The map has one entry for each slot, whatever the input, so it can be kept on the driver,
stored as JSON and broadcast.

Law: `bytes` - the shards' sizes are near equal. A record's key is hashed with its checksum and, among equal records, with its
number, so that neither rows that repeat a key nor rows without a key gather in one slot. Groups of equal texts are spread on
purpose: a group may hold a third of all rows, and kept together it would break the law.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloam.llm.common import Durable, documents, shared_dir

#: Virtual slots; a slot's share of the input is what a rebalancing can move at least.
SLOTS, SHARDS = 8192, 16
#: A shard's excess over the mean, as a part of it, that moves nothing; equal rows that are numbered at once.
NEAR, AT_ONCE = 1e-3, 1 << 16
LAW = "bytes"
NAMES = {"size", "text_crc32", "virtual_slot", "shard", "slot", "map_version"}


@dataclass
class SlotMap:
    """shard_of[slot]; every edit makes a new version and appends (version, slots moved) to the history."""

    shard_of: list[int]
    shards: int
    version: int = 1
    history: list[tuple[int, int]] = field(default_factory=list)

    @staticmethod
    def build(weights: list[int], shards: int) -> SlotMap:
        """Greedy: the heaviest slot goes to the lightest shard."""
        heap = [(0, s) for s in range(shards)]
        shard_of = [0] * len(weights)
        for slot in sorted(range(len(weights)), key=lambda s: (-weights[s], s)):
            load, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (load + weights[slot], shard))
        return SlotMap(shard_of, shards, 1, [(1, len(weights))])

    def rebalance(self, weights: list[int], shards: int | None = None) -> SlotMap:
        """A new version for other weights or another number of shards; moves slots from shards above the mean to shards below
        it, and all slots of shards that go. The heaviest slots that fit the excess go first and are placed first; slots of
        the heaviest and the lightest shard are then exchanged while that brings the two nearer to each other."""
        shards = self.shards if shards is None else shards
        w = np.array(weights, np.int64)
        out = np.array(self.shard_of)
        out[out >= shards] = -1
        load = np.bincount(out[out >= 0], w[out >= 0], shards).astype(np.int64)
        mean = int(w.sum()) / shards
        for shard in np.flatnonzero(load > mean * (1 + NEAR)).tolist():
            own = np.flatnonzero((out == shard) & (w > 0))
            for slot in own[np.argsort(-w[own], kind="stable")].tolist():
                if load[shard] - w[slot] >= mean:
                    load[shard] -= w[slot]
                    out[slot] = -1
        heap = [(int(x), s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        loose = np.flatnonzero(out < 0)
        for slot in loose[np.argsort(-w[loose], kind="stable")].tolist():
            x, shard = heapq.heappop(heap)
            out[slot] = shard
            heapq.heappush(heap, (x + int(w[slot]), shard))
        load = np.bincount(out, w, shards).astype(np.int64)
        for _ in range(64 * shards):
            high, low = int(load.argmax()), int(load.argmin())
            gap = int(load[high] - load[low])
            if load[high] <= mean * (1 + NEAR):
                break
            mine, others = np.flatnonzero(out == high), np.append(np.flatnonzero(out == low), -1)  # -1: nothing in exchange
            theirs = np.where(others >= 0, w[others], 0)
            order = np.argsort(theirs, kind="stable")
            others, theirs = others[order], theirs[order]
            want = w[mine] - gap / 2  # what would make the two equal
            at = np.searchsorted(theirs, want).clip(0, len(theirs) - 1)
            at = np.where((at > 0) & (np.abs(theirs[at - 1] - want) < np.abs(theirs[at] - want)), at - 1, at)
            step = w[mine] - theirs[at]
            good = (step > 0) & (step < gap)
            if not good.any():
                break
            best = int(np.where(good, np.abs(step - gap / 2), np.inf).argmin())
            out[mine[best]] = low
            if others[at[best]] >= 0:
                out[others[at[best]]] = high
            load[high] -= step[best]
            load[low] += step[best]
        out = out.tolist()
        moved = sum(a != b for a, b in zip(self.shard_of, out, strict=True))
        return SlotMap(out, shards, self.version + 1, [*self.history, (self.version + 1, moved)])

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "shards": self.shards, "shard_of": self.shard_of, "history": self.history})

    @staticmethod
    def from_json(text: str) -> SlotMap:
        x = json.loads(text)
        return SlotMap(x["shard_of"], x["shards"], x["version"], [tuple(h) for h in x["history"]])

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at path; the largest version is the one in force."""
        spark.createDataFrame([(self.version, self.to_json())], "version int, map string").coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        rows = spark.read.schema("version int, map string").parquet(path)
        rows = rows.where(F.col("version") == version) if version else rows
        return SlotMap.from_json(rows.orderBy(F.desc("version")).first()["map"])


def with_slots(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(__key, size, text_crc32, virtual_slot). Null text: no bytes, so size 1 and checksum 0. Rows that agree in all of it
    are counted first (before the shuffle, task by task) and numbered; the number goes into the hash."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("__key"), (F.length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"))
    counted = rows.groupBy("__key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / AT_ONCE))))
    numbered = lots.withColumn("__number", F.explode(F.sequence(F.col("lot") * AT_ONCE + 1, F.least("n", (F.col("lot") + 1) * AT_ONCE)))).drop("n", "lot")
    return numbered.withColumn("virtual_slot", F.pmod(F.xxhash64("__key", "text_crc32", "__number"), F.lit(slots)).cast("int"))


def slot_table(slotted: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: `slots` numbers each, whatever the input."""
    weights, rows = [0] * slots, [0] * slots
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        weights[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return weights, rows


def deal(spark: SparkSession, weights: list[int], shards: int, path: str) -> SlotMap:
    """Brings the stored map at path to the present sizes of the slots, and returns the version in force.

    Where none is stored, version 1 is built from the sizes. Else slots move while a shard is above the mean, and a further
    version is stored if any has to. A second call for the same rows moves nothing.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        SlotMap.build(weights, shards).save(spark, path)
    now = SlotMap.load(spark, path)
    new = now.rebalance(weights, shards)
    if new.shard_of != now.shard_of or new.shards != now.shards:
        new.save(spark, path)
    return SlotMap.load(spark, path)


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", slot_map: SlotMap | None = None, path: str | None = None, keep: Durable | None = None) -> tuple[DataFrame, SlotMap]:
    """(key, size, text_crc32, virtual_slot, shard, slot, map_version) and the map in force.

    With a slot_map its shards hold; with the path of a stored one, that is brought to the present sizes (see deal()); else one is
    built from the slots' bytes. The texts are read once: sizes and checksums are written to the shared folder. slot: the row's place in its shard,
    from 0 and without gaps: the slot's offset plus the rank in the slot, so that no task ranks a whole shard. Rows that agree
    in key, size and checksum (ties) get places of their own in different slots. Keys may be null and repeat; a key column
    that has the name of one of the others (size, shard, slot ...) is returned as `key`. Very long texts count whole; other
    columns are not read. An empty table gives no rows.
    """
    slotted = (keep or Durable(docs.sparkSession)).keep(with_slots(docs, key, text))
    weights, rows = slot_table(slotted)
    slot_map = slot_map or (deal(docs.sparkSession, weights, shards, path) if path else SlotMap.build(weights, shards))
    at, table = [0] * slot_map.shards, []
    for slot, s in enumerate(slot_map.shard_of):
        if rows[slot]:
            table.append((slot, s, at[s]))
            at[s] += rows[slot]
    spark = docs.sparkSession
    places = spark.createDataFrame(table, T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("offset", T.LongType())]))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("__key", "text_crc32", "size", "__number"))
    # at most SLOTS rows are broadcast
    out = slotted.withColumn("rank", rank).join(F.broadcast(places), "virtual_slot")
    name = "key" if key in NAMES else key
    return out.select(F.col("__key").alias(name), "size", "text_crc32", "virtual_slot", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(slot_map.version).alias("map_version")), slot_map


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards of documents of near equal bytes, by the table's map: it is stored in the shared folder under the table's name,
    brought to the sizes there and read again by every call; see shard() and deal()."""
    path = f"{shared_dir(spark)}/graphloam/slot_maps/{hashlib.sha256(sf_dir.encode()).hexdigest()[:32]}"
    out, _ = shard(documents(spark, sf_dir), SHARDS, path=path)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
