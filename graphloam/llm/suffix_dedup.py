"""Suffix-array dedup: repeated byte strings from merged Burrows-Wheeler transforms.

A byte goes if a string of `window` bytes around it also starts anywhere else, in the same document or another.

1. A window's anchor is the smallest hash of its grams (window - SPAN + 1 bytes each); equal windows have equal anchors. Blocks of
   anchors tell the documents which of their anchors stand at another place too, so most bytes leave here.
2. Consecutive windows with one such anchor are a segment; its bytes go to the block of the anchor. A task sends one segment
   for equal ones; the windows of those are repeated, and that is told at once.
3. What each task has sent to a block is a shard. The bytes are read as symbols of window / 8 bytes, at every offset. A shard
   sorts its own suffixes; its transform gives, for each suffix in order, the symbol before it. The shards' orders are then
   merged by interleave refinement: each round puts the symbol before a suffix in front of what is known of it, so that a
   merge of lists that are sorted already gives the interleave by one symbol more, and the round in which two neighbours
   part is the length of their common prefix. Suffixes without an equal leave; those that are left after `window` bytes are the
   repeated intervals. No suffixes of different shards are ever sorted together.
4. Anchors that very many places have (the edge of a passage in a third of all documents, with each document's own text beside
   it) would make one block. Their segments are asked about again, window by window, and only windows that stand at
   another place go on, to the blocks of their whole content.

Hashes (keyed anew for each run) only choose candidates and number symbols, whose bytes are compared; what is removed is exact.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphloam.llm.common import Durable, documents, lots, mix, partitions, small_batches, squeeze, unsqueezed, utf8
from graphloam.llm.packed import HELD, PACKED, buckets_for, by_bucket, meet, member, pack, text_bytes, ticket, unpack
from graphloam.llm.substring_dedup import _spans, marks_of, sliding_min

WINDOW = 400
#: Places in a window where its anchor may stand, at most; windows of a segment at most.
SPAN, MOST = 160, 256
#: Bytes of segments that a task gathers before it sends them; shards of a block.
HELD_BYTES, SHARDS = 12 << 20, 16
_ODD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
_COUNT = np.uint64(15)


def byte_grams(data: bytes, size: int, seed: int) -> np.ndarray:
    """A hash of each `size` consecutive bytes: of eight, then of twice as many from two of half."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.uint64(seed)
    if size < 8:
        lanes = np.ndarray((n,), np.uint64, data + bytes(8), strides=(1,)) & np.uint64((1 << 8 * size) - 1)
        return mix(lanes ^ key)
    out, have = mix(np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,)) ^ key), 8
    while have < size:
        step = min(have, size - have)
        x = out[:-step] * _ODD[0]
        x ^= x >> np.uint64(32)
        x += out[step:]
        x *= _ODD[1]
        x ^= x >> np.uint64(29)
        out, have = x, have + step
    return out


class Windows:
    """The windows of several texts: where each starts (in data), the number of its text, and its anchor (low four bits free)."""

    def __init__(self, texts: list[bytes], window: int, span: int, seed: int) -> None:
        self.data, self.window, self.span = b"".join(texts), window, span
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(size) - size
        self.gram = byte_grams(self.data, window - span + 1, seed) & ~_COUNT
        self.least = sliding_min(self.gram, span)
        edge = np.zeros(len(self.least) + 1, np.int8)
        whole = np.flatnonzero(size >= window)
        np.add.at(edge, self.first[whole], 1)
        np.add.at(edge, (self.first + size)[whole] - window + 1, -1)
        self.inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        self.at = np.flatnonzero(self.inside)
        self.anchor, self.text = self.least[self.at], np.searchsorted(self.first, self.at, side="right") - 1
        # of texts that begin at one place, all but the last are empty

    def places(self) -> np.ndarray:
        """The places that are the anchor of some window."""
        if not len(self.at):
            return self.at
        none = np.zeros(self.span - 1, np.uint64)
        least = np.where(self.inside, self.least, np.uint64(0))
        most = ~sliding_min(~np.concatenate((none, least, none)), self.span)
        near = ~sliding_min(~np.concatenate((none.astype(np.uint8), self.inside.view(np.uint8), none.astype(np.uint8))), self.span)
        return np.flatnonzero((most == self.gram) & (near > 0))

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def segments(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the given windows, by segment: its anchor, its text, its first byte, the end of its last, and whether its anchor
        stands in it more than once."""
        at, text, anchor = self.at[which], self.text[which], self.anchor[which]
        new = np.ones(len(which), bool)
        new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (at[1:] - at[:-1] != 1)
        begin = np.flatnonzero(new)
        new |= (np.arange(len(which)) - begin[np.cumsum(new) - 1]) % MOST == 0
        begin = np.flatnonzero(new)
        last = np.concatenate((begin[1:], [len(which)])) - 1
        places = self.places()
        lo, hi = np.searchsorted(places, at[begin]), np.searchsorted(places, at[last] + self.span)
        of = np.repeat(np.arange(len(begin)), hi - lo)
        near = places[np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        many = np.bincount(of[self.gram[near] == anchor[begin][of]], minlength=len(begin)) > 1
        return anchor[begin], text[begin], at[begin], at[last] + self.window, many


class Places:
    """Gathers (anchor, key) of places; sends an entry for each anchor with one of its keys and the logarithm of the number of
    its places in the low bits (kind 0), and tickets of the anchors that have several places here (kind 1)."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.n = buckets, 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, anchors: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((anchors, keys))
        self.n += len(anchors)
        if self.n > HELD:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, d = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
        self.held, self.n = [], 0
        order = np.argsort(h)
        h, d = h[order], d[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n = np.diff(np.concatenate((at, [len(h)])))
        yield pack((h[at] % np.uint64(self.buckets)).astype(np.int64), 0, h[at] | np.minimum(15, np.log2(n)).astype(np.uint64), d[at])
        several = np.repeat(n > 1, n)
        if several.any():
            yield pack(np.mod(d[several], self.buckets), 1, ticket(h[several], d[several]))


def settled(entries: DataFrame, buckets: int, hot: int) -> DataFrame:
    """The blocks of anchors: rows (bucket of the key, 0, tickets) for anchors with several entries, and what tasks have told
    themselves. Every bucket is told (kind 1) the anchors that more than `hot` places have, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = []
        for bucket, zero, one in by_bucket(batches):
            for blob in one:
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([0], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])
            if not zero:
                continue
            h, d = unpack(zero, 2)
            order = np.argsort(h)
            h, d = h[order], d[order].view(np.int64)
            at = np.flatnonzero(np.concatenate(([True], (h[1:] ^ h[:-1]) > _COUNT)))
            n = np.diff(np.concatenate((at, [len(h)])))
            places = np.add.reduceat(np.left_shift(1, (h & _COUNT).astype(np.int64)), at)
            h &= ~_COUNT
            if hot and (places > hot).any():
                frequent.append(h[at][places > hot])
            told = np.repeat(n > 1, n)
            if told.any():
                yield pack(np.mod(d[told], buckets), 0, ticket(h[told], d[told]))
        if frequent:
            blob = np.concatenate(frequent).tobytes()
            for begin in range(0, buckets, 512):
                to = np.arange(begin, min(begin + 512, buckets), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(to), np.int32)), pa.array([blob] * len(to), pa.binary())], names=["bucket", "kind", "blob"])

    return entries.repartition(partitions(entries.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, PACKED)


class Segments:
    """Gathers segments, and sends one for equal ones (kind: 0, or 2 for those that are asked about again) as blobs of (route,
    key, mark, place, size, flag) and the bytes. The windows of equal ones are repeated: their spans go straight on (kind 1)."""

    def __init__(self, buckets: int, kind: int) -> None:
        self.buckets, self.kind, self.size = buckets, kind, 0
        self.held: list[tuple[np.ndarray, ...]] = []
        self.bytes: list[bytes] = []

    def add(self, route: np.ndarray, keys: np.ndarray, marks: np.ndarray, first: np.ndarray, many: np.ndarray, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        self.held.append((route, keys, marks, first, many))
        self.bytes += parts
        self.size += sum(map(len, parts)) + 100 * len(parts)
        if self.size > HELD_BYTES:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.bytes:
            return
        route, keys, marks, first, many = (np.concatenate([x[i] for x in self.held]) for i in range(5))
        parts, self.held, self.bytes, self.size = self.bytes, [], [], 0
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(p, len(number)) for p in parts), np.int64, len(parts))
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        copies = np.bincount(of)
        several = copies[of] > 1
        if several.any():
            yield _spans(self.buckets, keys[several], marks[several], first[several], (first + n)[several])
        rows = np.unique(of, return_index=True)[1]  # the first of equal ones
        bucket = (route[rows] % np.uint64(self.buckets)).astype(np.int64) if self.kind == 0 else np.mod(keys[rows], self.buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(rows)]
        z, blobs = zstandard.ZstdCompressor(level=1), []
        for s, e in zip(cut, cut[1:], strict=False):
            r = rows[s:e]
            numbers = np.concatenate([route[r].view(np.int64), keys[r], marks[r].view(np.int64), first[r], n[r], many[r].astype(np.int64)])
            blobs.append(z.compress(len(r).to_bytes(8, "little") + numbers.tobytes() + b"".join([parts[i] for i in r.tolist()])))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(np.full(len(blobs), self.kind, np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def opened(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The six columns of a blob of segments, and their bytes."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    columns = np.frombuffer(raw, np.int64, 6 * n, 8).reshape(6, n)
    ends = (8 + 48 * n + np.cumsum(columns[4])).tolist()
    return columns, [raw[s:e] for s, e in zip([8 + 48 * n, *ends], ends, strict=False)]


def symbol_size(window: int) -> int:
    """Bytes of a symbol: the largest divisor of the window that is an eighth of it at most."""
    return max(s for s in range(1, max(1, window // 8) + 1) if window % s == 0)


def numbered(data: bytes, size: int, seed: int) -> np.ndarray:
    """A number for each `size` consecutive bytes, the same for equal ones only."""
    hashes = byte_grams(data, size, seed)
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    raw = np.frombuffer(data, np.uint8)
    same = first[of]
    if size < 8:
        return of  # these hashes are one to one
    lanes = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
    for at in sorted({*range(0, size - 7, 8), size - 8}):
        if (lanes[at : at + len(of)] != lanes[same + at]).any():  # two strings with one hash
            return np.unique(np.lib.stride_tricks.sliding_window_view(raw, size).copy().view(f"V{size}").ravel(), return_inverse=True)[1]
    return of


class Shard:
    """Suffixes of some segments of a block, in the order of their first `depth` symbols."""

    def __init__(self, begin: int, symbols: np.ndarray, room: np.ndarray, size: int, depth: int) -> None:
        rank, have, ranks = symbols, 1, {1: symbols}
        while have < depth:
            step = 1 << (min(have, depth - have).bit_length() - 1)
            ahead = np.zeros(len(rank), np.int64)
            if len(rank) > have * size:
                ahead[: -have * size] = np.where(room[: -have * size] >= (have + 1) * size, ranks[step][have * size :] + 1, 0)
            rank = np.unique(rank * (int(ranks[step].max(initial=0)) + 2) + ahead, return_inverse=True)[1]
            have += step
            ranks[have] = rank
        order = np.argsort(rank, kind="stable")
        self.order = begin + order[room[order] >= size]


def repeated(shards: list[list[bytes]], window: int, seed: int) -> list[np.ndarray]:
    """For each segment of each shard, where a window starts that also starts elsewhere in the block."""
    size = symbol_size(window)
    depth = window // size
    parts = [p for shard in shards for p in shard]
    data = b"".join(parts)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    stop = np.cumsum(length)
    room = np.repeat(stop, length) - np.arange(len(data))
    symbols = np.zeros(len(data), np.int64)
    if len(data) >= size:
        symbols[: len(data) - size + 1] = numbered(data, size, seed)
    ends = np.cumsum([sum(map(len, s)) for s in shards]).tolist()
    orders = [Shard(s, symbols[s:e], room[s:e], size, depth).order for s, e in zip([0, *ends], ends, strict=False)]
    at = np.concatenate(orders)  # shard by shard, each in its own order
    group = np.full(len(data) + size, -1, np.int64)
    known = symbols[at]
    for h in range(1, depth + 1):
        # lists that are sorted already, one for each shard, are merged; neighbours that differ part at h symbols
        interleave = np.argsort(known, kind="stable")
        new = np.concatenate(([True], np.diff(known[interleave]) != 0)) if len(at) else np.zeros(0, bool)
        numbers = np.cumsum(new) - 1
        several = np.bincount(numbers) > 1 if len(at) else np.zeros(0, bool)
        of = np.empty(len(at), np.int64)
        of[interleave] = numbers
        stays = several[of]
        group[at] = -1
        at, of = at[stays], of[stays]
        group[at] = of
        if h == depth or not len(at):
            break
        # the symbol before each suffix that is left, and what is known of the suffix
        goes = (room[at] >= (h + 1) * size) & (group[at + size] >= 0)
        before = group[at[goes] + size]
        group[at] = -1
        at = at[goes]
        known = symbols[at] * (len(several) + 1) + before
    out = [np.zeros(0, np.int64)] * len(parts)
    at = np.sort(at)
    of = np.searchsorted(stop, at, side="right")
    for s, e in zip(*_runs(of), strict=True):
        out[of[s]] = at[s:e] - (stop[of[s]] - length[of[s]])
    return out


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    cut = np.flatnonzero(np.diff(x)) + 1
    return ([0, *cut.tolist()], [*cut.tolist(), len(x)]) if len(x) else ([], [])


def settle_block(blobs: list[bytes], window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Spans (key, mark, first byte, end) of a block's repeated windows."""
    columns, parts, shard = [], [], []
    for i, blob in enumerate(blobs):
        c, p = opened(blob)
        columns.append(c)
        parts += p
        shard += [i % SHARDS] * len(p)
    route, keys, marks, first, n, many = np.concatenate(columns, axis=1)
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(p, len(number)) for p in parts), np.int64, len(parts))
    copies = np.bincount(of)
    equal = copies[of] > 1
    out = [(keys[equal], marks[equal], first[equal], (first + n)[equal])]
    rows = np.unique(of, return_index=True)[1]
    # an anchor that one segment has, once, stands nowhere else
    _, back, others = np.unique(route[rows], return_inverse=True, return_counts=True)
    rows = rows[(others[back] > 1) | (many[rows] > 0)]
    by_shard: list[list[int]] = [[] for _ in range(SHARDS)]
    for r in rows.tolist():
        by_shard[shard[r]].append(r)
    by_shard = [s for s in by_shard if s]
    if by_shard:
        starts = repeated([[parts[r] for r in s] for s in by_shard], window, seed)
        found = [(r, at) for r, at in zip((r for s in by_shard for r in s), starts, strict=True) if len(at) and not equal[r]]
        if found:
            r = np.repeat([x for x, _ in found], [len(at) for _, at in found])
            begin = first[r] + np.concatenate([at for _, at in found])
            out.append((keys[r], marks[r], begin, begin + window))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


def dedup_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, span: int | None = None, hot: int | None = None, keep: Durable | None = None) -> DataFrame:
    """docs with all their columns and __n_bytes, __n_removed, __spans (of removed bytes: first, end) and __kept (the remaining
    bytes; binary, as a cut may part a character).

    Null texts count as empty; those and texts shorter than a window lose nothing and are not shuffled. Keys may be of any type,
    repeat or be null: every row is a document, and rows that are equal lose their windows to each other. Matches never
    cross documents. A long text is hashed whole, a megabyte of it or one row at a time. Ties (a window at very many places) don't
    matter. An empty table gives no rows. Columns of docs that have one of the four new names are replaced; other clashes with
    names that are used on the way do no harm. span: places of an anchor in a window; hot: places from which on an anchor's
    windows are asked about one by one.
    """
    spark = docs.sparkSession
    keep = keep or Durable(spark)
    small_batches(spark)
    span, seed = span or max(1, min(SPAN, window * 2 // 5)), secrets.randbits(63)
    docs = docs.drop("__n_words", "__n_bytes", "__n_removed", "__spans", "__kept")
    spare = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    short = F.coalesce(F.octet_length(docs[text]), F.lit(0)) < window
    number = F.xxhash64(docs[key].cast("string"), docs[text])
    long = docs.where(~short).select(number.alias("k"), docs[text].alias("t"))
    buckets = buckets_for(spark, text_bytes(long, "t", "k")[0])
    hot = hot or 2 * buckets

    def ask(span: int) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Places(buckets)
            for keys, _, _, texts in batches_of(batches):
                w = Windows(texts, window, span, seed)
                at = w.places()
                yield from out.add(w.gram[at], keys[w.text_of(at)])
            yield from out.send()

        return run

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(keys, marks, places, texts): of rows (k, t), or of blobs of segments."""
        for batch in batches:
            if batch.schema.names == ["blob"]:
                for blob in batch.column(0).to_pylist():
                    c, parts = opened(blob)
                    for begin, some in lots(parts):
                        s = slice(begin, begin + len(some))
                        yield c[1, s], c[2, s].view(np.uint64), c[3, s], some
            else:
                keys = batch.column(0).to_numpy()
                for begin, some in lots(utf8(batch.column(1)) if pa.types.is_string(batch.schema.field(1).type) else unsqueezed(batch.column(1))):
                    yield keys[begin : begin + len(some)], None, np.zeros(len(some), np.int64), some

    def candidates(span: int) -> callable:
        def visit(known: np.ndarray, batch: pa.RecordBatch, state: dict) -> Iterator[pa.RecordBatch]:
            if "out" not in state:
                state["out"] = Segments(buckets, 0), Segments(buckets, 2)
            if not len(known):
                return
            if state["sorted"] is None:
                state["sorted"] = np.unique(unpack(state["runs"], 1)[0])
            for keys, marks, places, texts in batches_of(iter([batch])):
                w = Windows(texts, window, span, seed)
                which = np.flatnonzero(member(ticket(w.anchor, keys[w.text]), known))
                if not len(which):
                    continue
                route, of, first, end, many = w.segments(which)
                marks = marks_of(texts, keys) if marks is None else marks
                again = member(route, state["sorted"])
                for out, mine in zip(state["out"], (~again, again), strict=True):
                    if mine.any():
                        s, e, d = first[mine], end[mine], of[mine]
                        yield from out.add(route[mine], keys[d], marks[d], s - w.first[d] + places[d], many[mine], [w.data[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)])

        return visit

    def rest(state: dict) -> Iterator[pa.RecordBatch]:
        for out in state.get("out", ()):
            yield from out.send()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, zero, one in by_bucket(batches):
            for blob in one:
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])
            if zero:
                found = settle_block(zero, window, seed)
                if len(found[0]):
                    yield _spans(buckets, *found)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(blocks, PACKED)

    packed = T._parse_datatype_string(PACKED)
    bucket_of = F.pmod(F.col("k"), F.lit(buckets)).cast("int")
    shared = settled(long.mapInArrow(ask(span), PACKED), buckets, hot)
    texts = squeeze(long, "t").select(bucket_of.alias("bucket"), F.struct("k", "t").alias("row"))
    found = keep.keep(meet(texts, shared, packed, candidates(span), rest))
    spans_of = dealt(found.where("kind < 2"))
    again = found.where("kind = 2")
    if again.limit(1).count():
        alone = settled(again.select("blob").mapInArrow(ask(1), PACKED), buckets, 0)
        spans_of = spans_of.unionByName(dealt(meet(again.select("bucket", F.struct("blob").alias("row")), alone, packed, candidates(1), rest)))

    spans = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_bytes", T.LongType()), T.StructField("__n_removed", T.LongType()), T.StructField("__spans", spans), T.StructField("__kept", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    text_at, width = docs.columns.index(text), len(docs.columns)

    def cut(_: np.ndarray, batch: pa.RecordBatch, state: dict) -> Iterator[pa.RecordBatch]:
        if state["sorted"] is None:
            columns = unpack(state["runs"], 4)
            order = np.argsort(columns[1], kind="stable")
            state["sorted"] = [x[order].view(np.int64) if i != 1 else x[order] for i, x in enumerate(columns)]
        of, marks, starts, ends = state["sorted"]
        own, keys = unsqueezed(batch.column(text_at)), batch.column(width).to_numpy()
        mine = marks_of(own, keys)
        low, high = np.searchsorted(marks, mine, "left"), np.searchsorted(marks, mine, "right")
        removed, kept = [], []
        for i, data in enumerate(own):
            at = np.arange(low[i], high[i])[of[low[i] : high[i]] == keys[i]]
            merged: list[dict[str, int]] = []
            for s, e in sorted(zip(starts[at].tolist(), ends[at].tolist(), strict=True)):
                if merged and s <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], e)
                else:
                    merged.append({"first": s, "end": e})
            removed.append(merged)
            edges = [0, *(x for m in merged for x in (m["first"], m["end"])), len(data)]
            kept.append(b"".join(data[s:e] for s, e in zip(edges[0::2], edges[1::2], strict=True)) if merged else data)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(own, pa.binary()).cast(f.type) if i == text_at else c.cast(f.type) for i, (c, f) in enumerate(zip(batch.columns[:-1], arrow, strict=False))), pa.array(map(len, own), pa.int64()), pa.array([len(a) - len(b) for a, b in zip(own, kept, strict=True)], pa.int64()), pa.array(removed, arrow.field("__spans").type), pa.array(kept, pa.binary())], schema=arrow,
        )

    columns = [docs[c] for c in docs.columns]
    placed = squeeze(docs.where(~short).select(*columns, number.alias(spare)), text)
    whole = placed.select(F.pmod(F.col(spare), F.lit(buckets)).cast("int").alias("bucket"), F.struct(*(F.col(f"`{c}`") for c in docs.columns), spare).alias("row"))
    raw = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    untouched = docs.where(short).select(*columns, F.octet_length(raw).cast("long").alias("__n_bytes"), F.lit(0).cast("long").alias("__n_removed"), F.array().cast(spans).alias("__spans"), raw.alias("__kept"))
    return meet(whole, spans_of, schema, cut, lambda _: ()).unionByName(untouched)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document; see dedup_bytes()."""
    out = dedup_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.size("__spans").cast("long").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))
