"""Substring dedup by relative Lempel-Ziv parsing.

A document is factored greedily against what earlier documents (smaller keys) hold: from a word on, the longest run of words
that stands in a reference block is a factor; with none of WINDOW words, the word is a literal. Factors of WINDOW words or more
are duplicate spans, and so are the windows across a factor's boundary that a reference block has too: a window lies in a
factor, starts at a literal (where the parse has looked it up) or crosses a boundary (where it is looked up), so the spans
cover exactly the words that the repeated windows cover.

Reference blocks are cut by content, so that a document meets only the blocks that can hold a window of it:

1. A window's anchor is the smallest hash of its K-word grams; equal windows have equal anchors. Blocks of anchors tell the
   documents which of their anchors others have too.
2. Consecutive windows with one such anchor are a segment. Its words go to the reference block of the anchor.
3. A block numbers its words and sorts all suffixes of its segments (ranks by prefix doubling, then word by word as long as a
   match goes on). A segment's parse takes the longest match among smaller keys; words are compared, not hashes.

An anchor that very many documents have (a passage in a third of them, with each document's own words around it) would make one
block; the windows of such an anchor are segments of their own, dealt to the blocks by their whole content. A task sends one
segment for equal ones, that with the smallest key, and answers the others itself.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphloam.llm.common import Words, documents, grams, lots, mix, partitions, small_batches, squeeze, unsqueezed, utf8
from graphloam.llm.packed import PACKED, Answers, buckets_for, by_bucket, keys_of, meet, member, pack, settle, text_bytes, ticket, unpack

WINDOW, K = 13, 5
#: Windows of a segment at most; a longer run is cut into several, which loses none.
MOST = 32
#: Bytes of segments that a task gathers before it sends them.
HELD_BYTES = 12 << 20
_LOW = np.uint64(15)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


class Windows:
    """The windows of several documents: where each starts, its document's number and its anchor (low four bits free)."""

    def __init__(self, texts: list[bytes], window: int, k: int) -> None:
        self.words, self.window = Words(texts), window
        anchor = sliding_min(grams(self.words.hash, k), window - k + 1) & ~_LOW
        doc = self.words.doc
        self.at = np.flatnonzero(doc[: len(anchor)] == doc[window - 1 :]) if len(anchor) else np.zeros(0, np.int64)
        self.anchor, self.doc = anchor[self.at], doc[self.at]

    def hashes(self, which: np.ndarray) -> np.ndarray:
        at = self.at[which]
        out = np.full(len(at), self.window, np.uint64)
        for j in range(self.window):
            out = (out ^ self.words.hash[at + j]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return mix(out)

    def segments(self, which: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the given windows, by segment: what deals it to a block, its document, its first word and the end of its last."""
        at, doc, anchor = self.at[which], self.doc[which], self.anchor[which]
        alone = member(anchor, hot)
        new = np.ones(len(which), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (at[1:] - at[:-1] != 1) | alone[1:]
        begin = np.flatnonzero(new)
        new |= (np.arange(len(which)) - begin[np.cumsum(new) - 1]) % MOST == 0
        begin = np.flatnonzero(new)
        last = np.concatenate((begin[1:], [len(which)])) - 1
        route = np.where(alone[begin], self.hashes(which[begin]) | np.uint64(1), anchor[begin])
        return route, doc[begin], at[begin], at[last] + self.window


class Segments:
    """Gathers segments. Sends those with the smallest key among equal ones (kind 0) as blobs of (route, key, mark, place) and
    the words; the others are repeats: their spans go straight on (kind 1) as (key, mark, first word, end)."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.size = buckets, 0
        self.held: list[tuple[np.ndarray, ...]] = []
        self.words: list[bytes] = []

    def add(self, route: np.ndarray, keys: np.ndarray, marks: np.ndarray, first: np.ndarray, n: np.ndarray, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        self.held.append((route, keys, marks, first, n))
        self.words += words
        self.size += sum(map(len, words)) + 40 * len(words)
        if self.size > HELD_BYTES:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.words:
            return
        route, keys, marks, first, n = (np.concatenate([x[i] for x in self.held]) for i in range(5))
        words, self.held, self.words, self.size = self.words, [], [], 0
        least: dict[bytes, int] = {}
        for w, k in zip(words, keys.tolist(), strict=True):
            if k < least.get(w, k + 1):
                least[w] = k
        sent = np.fromiter(map(least.__getitem__, words), np.int64, len(words)) == keys
        rest = ~sent
        if rest.any():
            yield _spans(self.buckets, keys[rest], marks[rest], first[rest], first[rest] + n[rest])
        rows = np.flatnonzero(sent)
        bucket = (route[rows] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(rows)]
        z, blobs = zstandard.ZstdCompressor(level=1), []
        for s, e in zip(cut, cut[1:], strict=False):
            r = rows[s:e]
            numbers = np.concatenate([route[r].view(np.int64), keys[r], marks[r].view(np.int64), first[r], n[r]])
            blobs.append(z.compress(len(r).to_bytes(8, "little") + numbers.tobytes() + b"\n".join([words[i] for i in r.tolist()])))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(np.zeros(len(blobs), np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def _spans(buckets: int, keys: np.ndarray, marks: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans for the documents' buckets, those of one document merged where they touch."""
    order = np.lexsort((first, marks, keys))
    keys, marks, first, end = keys[order], marks[order], first[order], end[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)  # the farthest end so far, document by document
    new[1:] |= first[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    last = np.concatenate((begin[1:], [len(keys)])) - 1
    return pack(np.mod(keys[begin], buckets), 1, keys[begin], marks[begin], first[begin], reach[last])


class Block:
    """A reference block: segments with their keys and words, and the order of all their suffixes."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, words: list[bytes], window: int = WINDOW) -> None:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.keys, self.n, self.window = keys, n, window
        self.segment = np.repeat(np.arange(len(n)), n)
        self.begin = np.cumsum(n) - n
        self.stop = np.repeat(self.begin + n, n)  # where the segment of each word ends

    def longest(self) -> np.ndarray:
        """For each word, the length of the longest run from there on that a smaller key has too; 0 below a window."""
        out, have, rank = np.zeros(len(self.ids), np.int64), 1, self.ids
        while have < self.window and len(rank):
            step = min(have, self.window - have)
            rank = np.unique(rank[:-step] * (rank.max() + 1) + rank[step:], return_inverse=True)[1] if len(rank) > step else rank[:0]
            have += step
        at = np.flatnonzero(self.stop[: len(rank)] - np.arange(len(rank)) >= self.window)
        rank, length = rank[at], self.window
        while len(at):
            key = self.keys[self.segment[at]]
            order = np.lexsort((key, rank))
            new = np.ones(len(order), bool)
            new[1:] = rank[order][1:] != rank[order][:-1]
            group = np.cumsum(new) - 1
            repeat = np.empty(len(at), bool)
            repeat[order] = key[order] > key[order][new][group]
            out[at[repeat]] = length
            # suffixes with the same first words as one that goes on, and a word more
            goes_on = np.zeros(group[-1] + 1, bool)
            goes_on[group[repeat[order]]] = True
            kept = order[goes_on[group]]
            kept = kept[self.stop[at[kept]] - at[kept] > length]
            at, rank = at[kept], np.unique(rank[kept] * (self.ids.max() + 1) + self.ids[at[kept] + length], return_inverse=True)[1]
            length += 1
        return out

    def parse(self) -> tuple[np.ndarray, np.ndarray]:
        """All segments' greedy factors of a window or more: (first word, end), by place in the block."""
        longest, at, starts = self.longest(), self.begin.copy(), []
        live = np.flatnonzero(self.n >= self.window)
        while len(live):
            size = longest[at[live]]
            starts.append(at[live[size > 0]])
            at[live] += np.maximum(size, 1)
            live = live[self.begin[live] + self.n[live] - at[live] >= self.window]
        first = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self._longest = longest
        return first, first + longest[first]

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, first word in it, end) of all duplicate words: factors, and repeated windows across their boundaries."""
        first, end = self.parse()
        starts, ends = [first], [end]
        for back in range(1, self.window):
            at = end - back
            at = at[at > first]
            at = at[self._longest[at] > 0]
            starts.append(at)
            ends.append(at + self.window)
        edge = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(edge, np.concatenate(starts), 1)
        np.add.at(edge, np.concatenate(ends), -1)
        gone = np.cumsum(edge)[:-1] > 0
        new = np.zeros(len(gone) + 1, bool)
        new[self.begin] = True
        change = np.flatnonzero((gone != np.concatenate(([False], gone[:-1]))) | new[:-1])
        change = change[gone[change]]
        stop = np.flatnonzero(gone & ~(np.concatenate((gone[1:], [False])) & ~new[1:])) + 1
        return self.segment[change], change - self.begin[self.segment[change]], stop - self.begin[self.segment[change]]


def marks_of(texts: list[bytes], keys: np.ndarray) -> np.ndarray:
    """A number for each (text, key)."""
    return ticket(np.fromiter((int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in texts), np.uint64, len(texts)), keys)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """docs with all their columns and __n_words, __n_removed, __spans (of removed words: first, end) and __kept (the kept
    words, joined by one space).

    key: an integer column. Rows that repeat a key count as one document: they don't remove each other's words. Rows with a
    null key have and are no reference. Null and empty texts, and those of fewer words than a window, lose nothing. A long text
    is hashed and cut whole, a megabyte of it or one row at a time. Ties (a window that several earlier documents have) don't
    matter. An empty table gives no rows. Columns of docs that have one of the four new names are replaced; other clashes with
    names that are used on the way do no harm.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("__n_words", "__n_removed", "__spans", "__kept")
    has_key = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    size, keyless = text_bytes(docs, text, key)
    buckets = buckets_for(spark, size)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Answers(buckets, counted=True)
        for batch in batches:
            keys = keys_of(batch.column(0))
            for begin, texts in lots(utf8(batch.column(1))):
                w = Windows(texts, window, k)
                new = np.ones(len(w.doc), bool)
                new[1:] = (w.doc[1:] != w.doc[:-1]) | (w.anchor[1:] != w.anchor[:-1])
                yield from out.add(w.anchor[new], keys[begin + w.doc[new]])
        yield from out.send()

    shared_anchors = settle(has_key.mapInArrow(anchors, PACKED), buckets, hot=2 * buckets)

    def candidates(known: np.ndarray, batch: pa.RecordBatch, state: dict) -> Iterator[pa.RecordBatch]:
        out = state.setdefault("out", Segments(buckets))
        if not len(known):
            return
        if state["sorted"] is None:
            state["sorted"] = np.unique(unpack(state["runs"], 1)[0])
        keys = keys_of(batch.column(0))
        for begin, texts in lots(unsqueezed(batch.column(1))):
            w = Windows(texts, window, k)
            own = keys[begin : begin + len(texts)]
            which = np.flatnonzero(member(ticket(w.anchor, own[w.doc]), known))
            if len(which):
                route, doc, first, end = w.segments(which, state["sorted"])
                data = w.words.data
                words = [data[s:e] for s, e in zip(w.words.start[first].tolist(), w.words.end[end - 1].tolist(), strict=True)]
                yield from out.add(route, own[doc], marks_of(texts, own)[doc], first - w.words.first[doc], end - first, words)

    bucket_of = F.pmod(F.col("k"), F.lit(buckets)).cast("int")
    texts = squeeze(has_key, "t").select(bucket_of.alias("bucket"), F.struct("k", "t").alias("row"))
    segments = meet(texts, shared_anchors, T._parse_datatype_string(PACKED), candidates, lambda state: state["out"].send() if "out" in state else ())

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for bucket, zero, one in by_bucket(batches):
            for blob in one:
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])
            if not zero:
                continue
            columns, words = [], []
            for blob in zero:
                raw = z.decompress(blob)
                n = int.from_bytes(raw[:8], "little")
                columns.append(np.frombuffer(raw, np.int64, 5 * n, 8).reshape(5, n))
                words += raw[8 + 40 * n :].split()
            _, keys, marks, first, n = np.concatenate(columns, axis=1)
            segment, begin, end = Block(keys, n, words, window).repeats()
            if len(segment):
                yield _spans(buckets, keys[segment], marks[segment], first[segment] + begin, first[segment] + end)

    spans_of = segments.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(factor, PACKED)

    spans = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType()), T.StructField("__spans", spans), T.StructField("__kept", T.StringType())])
    arrow = to_arrow_schema(schema)
    key_at, text_at = docs.columns.index(key), docs.columns.index(text)

    def cut(_: np.ndarray, batch: pa.RecordBatch, state: dict) -> Iterator[pa.RecordBatch]:
        if state["sorted"] is None:
            found = unpack(state["runs"], 4)
            order = np.argsort(found[1], kind="stable")
            state["sorted"] = [x[order].view(np.int64) if i != 1 else x[order] for i, x in enumerate(found)]
        of, marks, starts, ends = state["sorted"]
        keys = batch.column(key_at).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        n_words, n_removed, removed, kept = [], [], [], []
        bodies = batch.column(text_at)
        bodies = bodies.cast(pa.binary()).to_pylist() if "raw" in state else unsqueezed(bodies)
        for begin, part in lots([b or b"" for b in bodies]):
            w = Words(part)
            edge = np.zeros(len(w.hash) + 1, np.int64)
            if len(marks):
                own_keys = keys[begin : begin + len(part)]
                own = marks_of(part, own_keys)
                low, high = np.searchsorted(marks, own, "left"), np.searchsorted(marks, own, "right")
                for d in np.flatnonzero(high > low).tolist():
                    mine = np.arange(low[d], high[d])[of[low[d] : high[d]] == own_keys[d]]
                    np.add.at(edge, w.first[d] + starts[mine], 1)
                    np.add.at(edge, w.first[d] + ends[mine], -1)
            gone = np.cumsum(edge)[:-1] > 0
            for d in range(len(part)):
                s, e = int(w.first[d]), int(w.first[d + 1])
                own_gone = gone[s:e]
                n_words.append(e - s)
                n_removed.append(int(own_gone.sum()))
                if not n_removed[-1]:
                    removed.append([])
                    kept.append(b" ".join(part[d].split()) if e > s else b"")
                    continue
                change = np.flatnonzero(np.diff(np.concatenate(([False], own_gone, [False])).view(np.int8))).tolist()
                removed.append([{"first": a, "end": b} for a, b in zip(change[0::2], change[1::2], strict=True)])
                kept.append(b" ".join(w.word(s + i) for i in np.flatnonzero(~own_gone).tolist()))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(bodies, pa.binary()).cast(f.type) if i == text_at else c.cast(f.type) for i, (c, f) in enumerate(zip(batch.columns, arrow, strict=False))), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, arrow.field("__spans").type), pa.array(kept, pa.binary()).cast(pa.string())], schema=arrow,
        )

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut(np.zeros(0, np.uint64), batch, {"sorted": None, "runs": [], "raw": True})

    columns = [docs[c] for c in docs.columns]
    spare = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    placed = squeeze(docs.where(docs[key].isNotNull()).select(*columns, F.pmod(docs[key].cast("long"), F.lit(buckets)).cast("int").alias(spare)), text)
    whole = placed.select(F.col(spare).alias("bucket"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = meet(whole, spans_of, schema, cut, lambda _: ())
    # rows without a key need no answers, and don't meet in one bucket
    return out.unionByName(docs.where(docs[key].isNull()).mapInArrow(untouched, schema)) if keyless else out


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document; see dedup()."""
    out = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES = {
    "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + {WINDOW - 1}], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM d WHERE len(ws) >= {WINDOW})),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS i FROM win JOIN first USING (s) WHERE m < doc_id),
lost AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""
}
