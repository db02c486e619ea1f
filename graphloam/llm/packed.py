"""Packed exchanges: documents ask blocks of hashes, and blocks answer documents, with arrays instead of rows.

A task gathers (hash, key) pairs and sends, for each block of hashes, one entry for a hash however many of its documents
have it; what it can tell its own documents it answers itself. The blocks settle the entries, and their answers meet the
documents again, bucket by bucket of the documents' keys. All of it streams through sorted partitions: a task holds one
bucket's arrays at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloam.llm.common import mix, partitions

PACKED = "bucket int, kind int, blob binary"
#: Entries that a task gathers before it sends them.
HELD = 1 << 20
#: Bytes of text that a bucket stands for; its arrays take about as much.
BUCKET_BYTES = 64 << 20
#: Low bits of a counted hash, which hold the binary logarithm of a count.
_COUNT = np.uint64(15)


def prime_from(n: int) -> int:
    """The first prime that is at least n."""
    while n < 2 or any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def text_bytes(rows: DataFrame, text: str, key: str) -> tuple[int, int]:
    """The bytes of a text column, and the number of rows without a key."""
    r = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b"), F.count_if(F.col(key).isNull()).alias("n")).first()
    return r["b"], r["n"]


def buckets_for(spark: SparkSession, size: int) -> int:
    """Buckets of a packed exchange for texts of `size` bytes: a prime, several for each shuffle partition, and so many that a
    bucket stands for BUCKET_BYTES of text at most."""
    return prime_from(max(509, 4 * partitions(spark), -(-size // BUCKET_BYTES)))


def pack(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, kind, blob): for each bucket the columns' values one after the other, eight bytes each."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    begins, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(bucket)]))
    columns = [c[order].view(np.int64) for c in columns]
    blobs = [b"".join(c[s:e].tobytes() for c in columns) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)] if len(bucket) else []
    first = bucket[begins] if len(bucket) else bucket
    return pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def unpack(blobs: list[bytes], width: int) -> list[np.ndarray]:
    """The columns of the blobs of one bucket, as unsigned 64-bit integers."""
    parts = [np.frombuffer(b, np.uint64).reshape(width, -1) for b in blobs]
    return list(np.concatenate(parts, axis=1)) if parts else [np.zeros(0, np.uint64)] * width


def ticket(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number for (hash, document key)."""
    return mix(hashes ^ mix(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def distinct(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted by hash and then by key."""
    order = np.lexsort((keys, hashes))
    h, d = hashes[order], keys[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


class Answers:
    """Gathers (hash, key) pairs; sends an entry for each hash with its smallest key (kind 0), and tickets of the pairs whose
    hash has another key here as well (kind 1). counted: the hashes' low four bits are free, and take the number of keys."""

    def __init__(self, buckets: int, counted: bool = False) -> None:
        self.buckets, self.counted, self.n = buckets, counted, 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, hashes: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((hashes, keys))
        self.n += len(hashes)
        if self.n > HELD:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, d = distinct(np.concatenate([x for x, _ in self.held]), np.concatenate([x for _, x in self.held]))
        self.held, self.n = [], 0
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(first)
        sent = h[at]
        if self.counted:
            sent = sent | np.minimum(15, np.log2(np.diff(np.concatenate((at, [len(h)]))))).astype(np.uint64)
        yield pack((h[at] % np.uint64(self.buckets)).astype(np.int64), 0, sent, d[at])
        known = ~first
        known[:-1] |= first[:-1] & ~first[1:]  # the first of several is told as well
        if known.any():
            yield pack(np.mod(d[known], self.buckets), 1, ticket(h[known], d[known]))


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(bucket, blobs of kind 0, blobs of kind 1) of a partition that is sorted by bucket."""
    now, zero, one = None, [], []
    for batch in batches:
        for b, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if b != now:
                if now is not None:
                    yield now, zero, one
                now, zero, one = b, [], []
            (one if kind else zero).append(blob)
    if now is not None:
        yield now, zero, one


def settle(entries: DataFrame, buckets: int, hot: int = 0) -> DataFrame:
    """The blocks: which entries other keys have too. Rows (bucket of the key, 0, tickets); what the tasks have answered
    themselves goes on. hot: the entries are counted, and every bucket is told (kind 1) the hashes that more than so many keys
    have; with 2 * buckets that is never more than a few bytes for each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = []
        for bucket, zero, one in by_bucket(batches):
            for blob in one:
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([0], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])
            if zero:
                h, d = unpack(zero, 2)
                if hot:
                    u, at = np.unique(h & ~_COUNT, return_inverse=True)
                    n = np.bincount(at, np.left_shift(1, (h & _COUNT).astype(np.int64)), len(u))
                    if (n > hot).any():
                        frequent.append(u[n > hot])
                    h = h & ~_COUNT
                h, d = distinct(h, d.view(np.int64))
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                told = ~first
                told[:-1] |= first[:-1] & ~first[1:]
                if told.any():
                    yield pack(np.mod(d[told], buckets), 0, ticket(h[told], d[told]))
        if frequent:
            blob = np.concatenate(frequent).tobytes()
            for begin in range(0, buckets, 512):
                to = np.arange(begin, min(begin + 512, buckets), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(to), np.int32)), pa.array([blob] * len(to), pa.binary())], names=["bucket", "kind", "blob"])

    return entries.repartition(partitions(entries.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, PACKED)


def meet(rows: DataFrame, tickets: DataFrame, schema: T.StructType, visit, finish) -> DataFrame:
    """Brings rows (bucket, row) and the answers for their bucket together; visit(sorted tickets, record batch of rows, state)
    and finally finish(state) give record batches of the schema. state["runs"] has the bucket's blobs of kind 1; state["sorted"] is None when a bucket begins."""
    row_schema = rows.schema["row"].dataType
    both = rows.select("bucket", F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("blob"), "row").unionByName(tickets.select("bucket", "kind", "blob", F.lit(None).cast(row_schema).alias("row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, known, state = None, [], np.zeros(0, np.uint64), {}
        for batch in batches:
            bucket, kind = (batch.column(i).to_numpy() for i in (0, 1))
            cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
                if s == e:
                    continue
                if bucket[s] != now:
                    now, blobs, known = bucket[s], [], np.zeros(0, np.uint64)
                    state["runs"], state["sorted"] = [], None
                if kind[s] == 0:
                    blobs += batch.column(2)[s:e].to_pylist()
                elif kind[s] == 1:
                    state["runs"] += batch.column(2)[s:e].to_pylist()
                else:
                    if blobs:
                        known, blobs = np.unique(unpack(blobs, 1)[0]), []
                    part = batch.column(3)[s:e]
                    yield from visit(known, pa.RecordBatch.from_arrays(part.flatten(), names=[f.name for f in part.type]), state)
        yield from finish(state)

    return both.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


def member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the known ones, which are sorted."""
    out = np.zeros(len(keys), bool)
    if len(known):
        size = 1 << max(10, min(22, int(len(known)).bit_length() + 4))
        maybe = np.zeros(size, bool)
        maybe[known & np.uint64(size - 1)] = True
        rows = np.flatnonzero(maybe[keys & np.uint64(size - 1)])
        at = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
        out[rows] = known[at] == keys[rows]
    return out


def keys_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)
