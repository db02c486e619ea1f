"""Helpers shared by the training-data operators.

* Arrow batches are kept small, since one document may be large.
* Words are hashed in numpy for a whole batch of documents at once.
* Intermediate tables that a later step reads more than once are written to the shared checkpoint folder, so that a lost
  executor costs a re-read and not a wrong result.
"""

from __future__ import annotations

import atexit
import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch that is sent to Python; texts may be long.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
#: Bytes of an input that is spread over the cores: at least, and for each core at most.
SMALL = 2 << 20, 8 << 20
#: Bytes of text that one numpy pass works on; arrays of some 60 times that size live at once.
PASS_BYTES = 1 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows and bytes of an Arrow batch for the Python stages of this session. The settings are read when a plan
    runs, after the operator has returned it, so they stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="graphloam-"))
        found = _own_dir[0]
    return found


_own_dir: list[str] = []


class Durable:
    """Tables written to the shared folder; drop() removes one that is no longer needed, the end of the process the rest."""

    _scopes: ClassVar[list[list[Durable]]] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.live = spark, []
        atexit.register(self.close)
        if self._scopes:
            self._scopes[-1].append(self)

    @classmethod
    @contextmanager
    def scope(cls) -> Iterator[None]:
        """Drops at its end the tables of every Durable that was made inside; what was planned on them has to be written by
        then."""
        cls._scopes.append([])
        try:
            yield
        finally:
            for made in cls._scopes.pop():
                made.close()

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/graphloam/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.live.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._graphloam_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._graphloam_path)

    def _delete(self, path: str) -> None:
        if path in self.live:
            self.live.remove(path)
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

    def close(self) -> None:
        for path in list(self.live):
            try:
                self._delete(path)
            except Exception:  # noqa: BLE001  the session may already be gone at exit
                return


# ------------------------------------------------------------------------------------------------ words as numpy hashes

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z in lower case, all other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: Seeds of the two independent word hashes; bytes that are hashed in lanes of eight; longer words are hashed one by one.
SEEDS, LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), 64
_LANE_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def hash_words(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of 64 bits for each data[start:end]. Its seeds are public, so words that agree can be built: use it where agreement
    only chooses candidates, and keyed_words() where it decides."""
    size, key = end - start, SEEDS[seed]
    out = (size.astype(np.uint64) + np.uint64(1)) * key
    lanes = np.ndarray((len(data) + 1,), np.uint64, data + bytes(8), strides=(1,))
    short = np.flatnonzero(size <= LANES)
    at, left = start[short], size[short]
    while len(short):
        h = (out[short] ^ (lanes[at] & _LANE_MASK[np.minimum(left, 8)])) * np.uint64(0xFF51AFD7ED558CCD) + key
        out[short] = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        more = left > 8
        short, at, left = short[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=key.tobytes()).digest(), "little")
    return mix(out)


def new_keys(n: int = 2) -> tuple[tuple[int, int], ...]:
    """Keys for keyed_words(), drawn anew; the tasks of a run share them."""
    return tuple((secrets.randbits(64), secrets.randbits(64)) for _ in range(n))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _sip_round(v: list[np.ndarray]) -> None:
    v[0] = v[0] + v[1]
    v[2] = v[2] + v[3]
    v[1] = _turn(v[1], 13) ^ v[0]
    v[3] = _turn(v[3], 16) ^ v[2]
    v[0] = _turn(v[0], 32) + v[3]
    v[2] = v[2] + v[1]
    v[3] = _turn(v[3], 21) ^ v[0]
    v[1] = _turn(v[1], 17) ^ v[2]
    v[2] = _turn(v[2], 32)


def keyed_words(data: bytes, start: np.ndarray, end: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """SipHash-2-4 of each data[start:end] under a key of 128 bits: who doesn't know the key can't build words that agree.
    Words longer than LANES are hashed by keyed BLAKE2b."""
    size = end - start
    out = np.zeros(len(size), np.uint64)
    lanes = np.ndarray((len(data) + 1,), np.uint64, data + bytes(8), strides=(1,))
    rows = np.flatnonzero(size <= LANES)
    at, left = start[rows], size[rows]
    # fixed values: the hash's constants, "somepseudorandomlygeneratedbytes"
    v = [np.full(len(rows), key[i % 2] ^ c, np.uint64) for i, c in enumerate((0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573))]
    while len(rows):
        last = left < 8
        lane = np.where(last, (lanes[at] & _LANE_MASK[np.minimum(left, 8)]) | (size[rows].astype(np.uint64) << np.uint64(56)), lanes[at])
        v[3] = v[3] ^ lane
        _sip_round(v)
        _sip_round(v)
        v[0] = v[0] ^ lane
        if last.any():
            w = [x[last] for x in v]
            w[2] = w[2] ^ np.uint64(0xFF)
            for _ in range(4):
                _sip_round(w)
            out[rows[last]] = w[0] ^ w[1] ^ w[2] ^ w[3]
            more = ~last
            rows, at, left, v = rows[more], at[more], left[more], [x[more] for x in v]
        at, left = at + 8, left - 8
    secret = b"".join(k.to_bytes(8, "little") for k in key)
    for i in np.flatnonzero(size > LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=secret).digest(), "little")
    return out


class Words:
    """The words of several documents: hashes, byte ranges and the document's number, all in one pass.

    data: the documents' UTF-8 bytes, a space after each. doc[i] is the number of the document that word i is in;
    first[d]:first[d + 1] are the words of document d. keys: of keyed hashes, for hash and for second().
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES, keys: tuple[tuple[int, int], ...] | None = None) -> None:
        self.data = b" ".join(texts) + b" "
        ends_of = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        apart = separators[np.frombuffer(self.data, np.uint8)]
        apart[ends_of - 1] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([True], apart)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.keys = keys
        self.hash = keyed_words(self.data, self.start, self.end, keys[0]) if keys else hash_words(self.data, self.start, self.end)
        self.doc = np.searchsorted(ends_of, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def second(self) -> np.ndarray:
        """Hashes of the words that are independent of the first ones; both together are 128 bits."""
        return keyed_words(self.data, self.start, self.end, self.keys[1]) if self.keys else hash_words(self.data, self.start, self.end, 1)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; entry i starts at word i. The caller leaves out those that cross documents."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def lots(batch_texts: list[bytes], most: int = PASS_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of documents of some `most` bytes together; a longer document is a run of its own."""
    begin, size = 0, 0
    for i, t in enumerate(batch_texts):
        if i > begin and size + len(t) > most:
            yield begin, batch_texts[begin:i]
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(batch_texts):
        yield begin, batch_texts[begin:]


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores if they are few megabytes a core, as a small file may be one row group and so one task. Larger inputs
    have tasks enough and are not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if cores > 1 and SMALL[0] <= size <= cores * SMALL[1] else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def join_common(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined with table (a row for each `on`; `count`: how many of rows, `total` in all, have it). Keys that more than a
    thousandth of the rows have - a thousand at most - are joined by a broadcast, so their rows don't meet in one task; the
    others by a merge join, as table grows with the data and the planner's estimate of it may not."""
    many = max(100, total // 1000)
    common = table.where(F.col(count) > many)
    rest = rows.join(F.broadcast(common.select(*on)), on, "left_anti").join(table.where(F.col(count) <= many).hint("merge"), on)
    return rows.join(F.broadcast(common), on).unionByName(rest)


# ------------------------------------------------------------------------------------------------- texts on their way


def squeeze(rows: DataFrame, text: str) -> DataFrame:
    """rows with the text column as zstd frames (nulls stay), for a shuffle of texts: two thirds of what the shuffle's own
    compression leaves."""
    at = rows.columns.index(text)
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if i == at else f.dataType, True) for i, f in enumerate(rows.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([None if x is None else z.compress(x) for x in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def unsqueezed(column: pa.Array) -> list[bytes | None]:
    z = zstandard.ZstdDecompressor()
    return [None if x is None else z.decompress(x) for x in column.to_pylist()]
