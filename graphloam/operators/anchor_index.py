"""Anchor search by stored postings: which nodes hold a keyword anywhere in their label or metadata, without reading the nodes.

A posting says where a run of three characters stands in a node's lower-cased text (at a text's end, also the runs of two and
one). A keyword stands where all of its runs stand in a row, so positions decide and no text is compared. Nodes are dealt to
segments of bounded size, in which they are numbered; a segment's postings of a run are one packed row, and its nodes' ids another,
under the empty run. Only packed rows go through shuffles, when the index is built and when it is searched. They are stored by a
bucket of the run's first two characters and sorted by run, so a search reads the keywords' postings and the ids only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.operators.graph_query import NODE
from graphloam.operators.retrieval import MAX_ANCHORS
from graphloam.plans.versions import Versions
from graphloam.schemas import NODES

GRAM, BUCKETS, SPREAD = 3, 64, 16
#: Nodes of a segment at most, and characters after which one ends.
SEGMENT, CHARACTERS = 32768, 1 << 21
SCHEMAS = {
    "postings": "gram string, repositoryId string, segment long, n int, held binary, bucket int",
    "nodes": f"{NODES}, bucket int",
}
_PACKED = "gram string, repositoryId string, segment long, n int, held binary"


def _bucket(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(BUCKETS)).cast("int")


def _pack(numbers: np.ndarray) -> bytes:
    """The width in bytes and the numbers; width 0 and one of four bytes if all are equal."""
    if len(numbers) and (numbers == numbers[0]).all():
        return b"\0" + int(numbers[0]).to_bytes(4, "little")
    most = int(numbers.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpack(blob: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """n packed numbers, and where what follows them begins."""
    width = blob[at]
    if not width:
        return np.full(n, int.from_bytes(blob[at + 1 : at + 5], "little"), np.int64), at + 5
    return np.frombuffer(blob, f"<u{width}", n, at + 1).astype(np.int64), at + 1 + n * width


def _segment(ids: list[str], texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
    """(run, number of postings, packed postings) of the labels and, after them, the metadata of the nodes; the ids first."""
    encoded = [i.encode() for i in ids]
    yield "", len(ids), _pack(np.array([len(e) for e in encoded])) + b"".join(encoded)
    lengths = np.array([len(t) for t in texts])
    total = int(lengths.sum())
    if not total:
        return
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    there = np.zeros(int(points.max()) + 1, bool)
    there[points] = True
    letters = np.flatnonzero(there)
    rank = np.cumsum(there)[points]  # from 1; 0 is no character
    text = np.repeat(np.arange(len(texts)), lengths)
    position = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[text] - position
    rank = np.concatenate([rank, [0, 0]])
    base = len(letters) + 1
    run = (rank[:-2] * base + np.where(left > 1, rank[1:-1], 0)) * base + np.where(left > 2, rank[2:], 0)
    order = np.argsort(run, kind="stable")
    begin = np.flatnonzero(np.diff(run[order], prepend=-1))
    for s, e in zip(begin.tolist(), [*begin[1:].tolist(), total], strict=True):
        at = order[s:e]
        number = int(run[at[0]])
        gram = "".join(chr(letters[r - 1]) for r in (number // base // base, number // base % base, number % base) if r)
        yield gram, e - s, _pack(np.diff(text[at], prepend=0)) + _pack(position[at])


def postings(nodes: DataFrame) -> DataFrame:
    """(gram, repositoryId, segment, n, held) of nodes with a label. Segments hold nodes of one repository; what they hold is
    told by ids alone, so that a task that is run again gives the same ones."""
    lower = lambda c: F.make_valid_utf8(F.lower(F.coalesce(F.col(c), F.lit(""))))
    texts = nodes.where(F.col("label").isNotNull()).select("id", "repositoryId", lower("label").alias("label"), lower("metadataJson").alias("metadata"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, now = TaskContext.get().partitionId() << 24, [], 0, None

        def packed() -> pa.RecordBatch:
            grams, ns, blobs = zip(*_segment([h[0] for h in held], [h[2] for h in held] + [h[3] for h in held]), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([now] * len(grams), pa.string()), pa.array([number] * len(grams), pa.int64()), pa.array(ns, pa.int32()), pa.array(blobs, pa.binary())], names=["gram", "repositoryId", "segment", "n", "held"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[1] != now or len(held) >= SEGMENT or size >= CHARACTERS):
                    yield packed()
                    number, held, size = number + 1, [], 0
                now = row[1]
                held.append(row)
                size += len(row[2]) + len(row[3])
        if held:
            yield packed()

    return texts.repartition(parts, "id").sortWithinPartitions("repositoryId", "id").mapInArrow(run, _PACKED)


def _holders(rows: dict[str, tuple[int, bytes]], word: str) -> np.ndarray:
    """The numbers of a segment's nodes that hold the word."""
    nodes = rows[""][0]

    def held(gram: str) -> tuple[np.ndarray, np.ndarray]:
        n, blob = rows[gram]
        texts, at = _unpack(blob, n)
        return np.cumsum(texts), _unpack(blob, n, at)[0]

    if not word:
        return np.arange(nodes)
    if len(word) < GRAM:
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(held(g)[0] for g in rows if g)]) % nodes)
    runs = [(word[i : i + GRAM], i) for i in range(len(word) - GRAM + 1)]
    if any(g not in rows for g, _ in runs):
        return np.zeros(0, np.int64)
    found = None
    for gram, offset in sorted(runs, key=lambda r: rows[r[0]][0]):  # the rarest first
        texts, at = held(gram)
        ok = at >= offset
        starts = (texts[ok] << 32) + at[ok] - offset
        found = starts if found is None else found[np.isin(found, starts, assume_unique=True)]
    return np.unique((found >> 32) % nodes)


class AnchorIndex:
    """Postings of a graph's nodes in a folder, versioned."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.versions = spark, Versions(spark, path, SCHEMAS)

    def build(self, nodes: DataFrame) -> None:
        """Indexes nodes; ids are unique."""
        change = self.versions.begin()
        change.tables = {}
        self._add(change, nodes)

    def add(self, nodes: DataFrame) -> None:
        """More nodes, of new ids."""
        self._add(self.versions.begin(), nodes)

    def _add(self, change, nodes: DataFrame) -> None:  # noqa: ANN001
        rows = postings(nodes).withColumns({"segment": F.col("segment") + F.lit(change.number << 44), "bucket": _bucket(F.substring("gram", 1, 2))})
        change.add("postings", rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("segment"), F.lit(SPREAD))).sortWithinPartitions("bucket", "gram", "segment"), by="bucket")
        change.add("nodes", nodes.select(*NODE).withColumn("bucket", _bucket(F.col("id"))).repartition("bucket").sortWithinPartitions("bucket", "id"), by="bucket")
        change.commit()

    def matches(self, words: list[str], repository: str | None = None) -> DataFrame:
        """(id) of the nodes that hold any of the words, each once. Words are compared as they are with lower-cased text; an empty
        one stands in every text."""
        words, rows = list(dict.fromkeys(words)), self.versions.read("postings")
        rows = rows if repository is None else rows.where(F.col("repositoryId") == repository)
        out = None
        for word in words:
            found = self._holding(rows, word)
            out = found if out is None else out.unionByName(found)
        return self.spark.createDataFrame([], "id string") if out is None else out if len(words) == 1 else out.distinct()

    def _buckets(self, starts: list[str]) -> list[int]:
        of = self.spark.createDataFrame([(s,) for s in starts], "s string")
        return [r[0] for r in of.select(_bucket(F.substring("s", 1, 2))).distinct().collect()]

    def _holding(self, rows: DataFrame, word: str) -> DataFrame:
        """(id) of the nodes that hold the word. A segment's rows meet in one task."""
        names = sorted({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)} | {""}) if len(word) >= GRAM or not word else ["", word]
        if len(word) != 1:  # runs that begin with one character are in any bucket
            rows = rows.where(F.col("bucket").isin(self._buckets(names)))
        rows = rows.where(F.col("gram").isin(names) if len(word) >= GRAM or not word else (F.col("gram") == "") | F.startswith("gram", F.lit(word)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found(of: dict[str, tuple[int, bytes]]) -> pa.RecordBatch:
                (n, blob), at = of[""], _holders(of, word)
                lengths, begin = _unpack(blob, n)
                ends = begin + np.cumsum(lengths)
                return pa.RecordBatch.from_arrays([pa.array([blob[ends[i] - lengths[i] : ends[i]].decode() for i in at.tolist()], pa.string())], names=["id"])

            now, held = None, {}
            for batch in batches:
                for segment, gram, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and segment != now:
                        yield found(held)
                        held = {}
                    now = segment
                    held[gram] = n, blob
            if held:
                yield found(held)

        return rows.select("segment", "gram", "n", "held").repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "id string")

    def find(self, words: list[str], repository: str | None = None, limit: int = MAX_ANCHORS) -> DataFrame:
        """P5, L2: find_anchors(), from the postings: the first nodes by id that a keyword matches. The `limit` ids come to the
        driver, and the nodes are read from their buckets."""
        ids = [r["id"] for r in self.matches(words, repository).orderBy("id").limit(limit).collect()]
        if not ids:
            return self.spark.createDataFrame([], NODES)
        of = self.spark.createDataFrame([(i,) for i in ids], "i string")
        buckets = [r[0] for r in of.select(_bucket(F.col("i"))).distinct().collect()]
        return self.versions.read("nodes").where(F.col("bucket").isin(buckets) & F.col("id").isin(ids)).select(*NODE).orderBy("id")
