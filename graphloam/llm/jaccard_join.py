"""N-gram Jaccard join with prefix filters under several global token orders.

A document is the set of its shingles; two documents link when their Jaccard similarity reaches the threshold. If it does,
a set of n shingles has at most miss(n) shingles that the other one lacks, so whatever the global order of the tokens, the
two prefixes of miss(n) + l tokens share l tokens. Candidates must pass under every order:

1. Orders: ascending and descending hash. Every document sends both prefixes; blocks of tokens answer which tokens other
   documents have in a prefix too. Only documents with enough such tokens under both orders go on, with their whole set.
2. Equal sets collapse to the one with the smallest key.
3. Order: rarest first, by exact document frequencies among what is left. Sets with too few tokens of frequency 2 or more
   have no partner; documents whose prefixes share a token fall into one class (connected components).
4. A class is cut into blocks of bounded size, and pairs of blocks are verified, one in a task: prefixes must meet under two
   more orders (rarest first, ties by ascending and by descending hash), then the exact intersections decide. A task sends
   a spanning forest of its links, so pairs are never listed. Every block meets itself and the first one; that joins the whole
   class where it is a group of near copies, and only the classes that are not one component then meet block by block.

The components of the forests are the components of all links. Shingles are told apart by hashes of 64 bits of their words, equal
sets by 128, under keys drawn anew for each run: nobody can write documents that link without sharing words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloam.llm.common import LOWER, Durable, Words, documents, grams, join_common, lots, mix, new_keys, partitions, small_batches, squeeze, unsqueezed, utf8
from graphloam.llm.components import components
from graphloam.llm.packed import PACKED, Answers, buckets_for, by_bucket, keys_of, meet, member, pack, settle, text_bytes, ticket, unpack

SHINGLE = 4
#: The threshold as a fraction.
NUMERATOR, DENOMINATOR = 85, 100
#: Documents of a block in expectation.
BLOCK = 128


def miss(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles of n that a linked set may lack."""
    return n - -(-n * num // den)


class Sets:
    """The distinct shingles of several documents: hash and doc, sorted by document and hash; n: the sets' sizes."""

    def __init__(self, texts: list[bytes], size: int, keys: tuple[tuple[int, int], ...] | None = None) -> None:
        self.size = size
        w = self.words = Words([t.translate(LOWER) for t in texts], keys=keys)
        h, d = self._shingles(w.hash)
        self._order = order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        self.hash, self.doc, self._new = h[new], d[new], new
        self.n = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n)))

    def _shingles(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles from hashes of the words, and their documents."""
        w, size = self.words, self.size
        g = grams(words, size)
        at = np.flatnonzero(w.doc[: len(g)] == w.doc[size - 1 :]) if len(g) else np.zeros(0, np.int64)
        hashes, doc, count = [g[at]], [w.doc[at]], np.diff(w.first)
        for n in range(1, size):
            few = np.flatnonzero(count == n)
            if len(few):  # the whole sequence is one shingle
                starts = w.first[few]
                hashes.append(grams(words[(starts[:, None] + np.arange(n)).ravel()], n)[::n])
                doc.append(few)
        return np.concatenate(hashes), np.concatenate(doc)

    def prefixes(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the tokens in the prefixes under ascending and descending hash."""
        p = miss(self.n, num, den) + 1 + self.n // 20
        place = np.arange(len(self.hash)) - self.first[self.doc]
        return place < p[self.doc], place >= (self.n - p)[self.doc]

    def enough(self, known: np.ndarray, num: int, den: int) -> np.ndarray:
        """Documents with as many known tokens under both orders as a partner would give them."""
        need = 1 + -(-self.n * num // den) // 20
        up, down = self.prefixes(num, den)
        return (self.n > 0) & (np.bincount(self.doc[known & up], minlength=len(self.n)) >= need) & (np.bincount(self.doc[known & down], minlength=len(self.n)) >= need)

    def fingerprints(self) -> list[bytes]:
        """16 bytes for each set, of two independent hashes of its shingles."""
        second = self._shingles(self.words.second())[0][self._order][self._new]
        a, b = (np.concatenate(([np.uint64(0)], np.cumsum(mix(h), dtype=np.uint64))) for h in (self.hash, second))
        x, y = a[self.first[1:]] - a[self.first[:-1]], b[self.first[1:]] - b[self.first[:-1]]
        return [p.tobytes() + q.tobytes() for p, q in zip(x, y, strict=True)]


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links(sets: list[np.ndarray], left: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets[:left] and sets[left:], or among all if left is 0."""
    n = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), n)
    tokens, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    can = np.outer(n * den, np.ones(len(n), np.int64)) >= num * n  # the size filter, one way
    can &= can.T
    for tie in (np.arange(len(tokens)), -np.arange(len(tokens))):
        rank = np.empty(len(tokens), np.int64)
        rank[np.lexsort((tie, df))] = np.arange(len(tokens))
        order = np.lexsort((rank[column], doc))
        inside = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(miss(n, num, den) + 1, n)
        rows, cols = doc[order][inside], column[order][inside]
        can &= _intersections(rows, cols, df, len(n)) > 0
    np.fill_diagonal(can, False)
    if left:
        can[:left, :left] = can[left:, left:] = False
    live = np.flatnonzero(can.any(1))
    if not len(live):
        return []
    place = np.full(len(n), -1)
    place[live] = np.arange(len(live))
    own = place[doc] >= 0
    both = _intersections(place[doc[own]], column[own], df, len(live))
    m, ok = n[live], can[np.ix_(live, live)]
    ok &= (num + den) * both >= num * (m[:, None] + m[None, :])
    forest, out = Forest(len(live)), []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(ok))), strict=True):
        if forest.join(i, j):
            out.append((int(live[i]), int(live[j])))
    return out


def _intersections(rows: np.ndarray, columns: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """How many columns each two rows share: matrix products over bounded runs of columns."""
    out = np.zeros((n, n), np.float32)
    use = df[columns] > 1
    rows, columns = rows[use], columns[use]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    at = np.concatenate(([0], np.cumsum(np.diff(columns) != 0))) if len(columns) else columns
    width = max(64, min(4096, (4 << 20) // max(1, n)))
    for begin in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        s, e = np.searchsorted(at, [begin, begin + width])
        x = np.zeros((n, width), np.float32)
        x[rows[s:e], at[s:e] - begin] = 1
        out += x @ x.T
    return out.astype(np.int64)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, block: int = BLOCK, keep: Durable | None = None) -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs.

    key: an integer column. Words are runs without ASCII white space, A-Z lower-cased. Sets are of distinct shingles; a
    shorter text is one shingle, a null or blank one has none and links with nothing. Keys are meant to be unique: rows
    that repeat a key and its text share their component, other rows that repeat a key get the component of their own set.
    Rows with a null key link with nothing and have no component. Very long texts are hashed whole, a megabyte or one row at a
    time. Ties (equal sets) collapse before they are compared. Other columns are not read. Equal sets are told by 128 bits of
    two independent hashes.
    """
    spark, keep = docs.sparkSession, keep or Durable(docs.sparkSession)
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    buckets, parts, keys_of_run = buckets_for(spark, text_bytes(rows, "t", "k")[0]), partitions(spark), new_keys()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Answers(buckets)
        for batch in batches:
            keys = keys_of(batch.column(0))
            for begin, texts in lots(utf8(batch.column(1))):
                s = Sets(texts, shingle, keys_of_run)
                up, down = s.prefixes(num, den)
                yield from out.add(s.hash[up | down], keys[begin + s.doc[up | down]])
        yield from out.send()

    answers = settle(rows.where("k is not null").mapInArrow(prefixes, PACKED), buckets)

    def survive(known: np.ndarray, batch: pa.RecordBatch, _: dict) -> Iterator[pa.RecordBatch]:
        null, keys = batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        for begin, texts in lots([t or b"" for t in unsqueezed(batch.column(1))]):
            s = Sets(texts, shingle, keys_of_run)
            own = keys[begin : begin + len(texts)]
            go = s.enough(member(ticket(s.hash, own[s.doc]), known), num, den) & ~null[begin : begin + len(texts)]
            marks = s.fingerprints() if go.any() else [b""] * len(texts)
            sets = [s.hash[s.first[i] : s.first[i + 1]].tobytes() if go[i] else None for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0)[begin : begin + len(texts)], pa.array(s.n), pa.array([m if g else None for m, g in zip(marks, go, strict=True)], pa.binary()), pa.array(sets, pa.binary())], names=["k", "n", "mark", "tokens"])

    place = F.pmod(F.coalesce("k", F.crc32(F.coalesce("t", F.lit("")).cast("binary"))), F.lit(buckets)).cast("int")
    told = keep.keep(meet(squeeze(rows.select("k", "t", place.alias("bucket")), "t").select("bucket", F.struct("k", "t").alias("row")), answers, T._parse_datatype_string("k long, n long, mark binary, tokens binary"), survive, lambda _: ()))
    marked = told.where("mark is not null")
    heads = keep.keep(marked.groupBy("mark").agg(F.min("k").alias("head"), F.count(F.lit(1)).alias("copies")))
    sets = keep.keep(marked.join(heads, (marked["mark"] == heads["mark"]) & (marked["k"] == heads["head"]), "left_semi").groupBy("k", "mark").agg(F.first("tokens").alias("tokens")).select(F.pmod("k", F.lit(buckets)).cast("int").alias("bucket"), "k", "tokens"))

    # document frequencies: a bucket of documents sends (token, number of its documents), and gets (token, frequency) back
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs, _ in by_bucket(batches):
            h, n = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs]), return_counts=True)
            yield pack((h % np.uint64(buckets)).astype(np.int64), bucket, h, n.astype(np.int64))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reply(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            of = np.concatenate([np.full(len(b) // 16, at, np.int64) for at, b in held])
            h, n = unpack([b for _, b in held], 2)
            u, back = np.unique(h, return_inverse=True)
            df = np.bincount(back, n.astype(np.int64), len(u)).astype(np.int64)[back]
            if (df > 1).any():
                yield pack(of[df > 1], 0, h[df > 1], df[df > 1])

        now, held = None, []
        for batch in batches:
            for b, at, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != now and held:
                    yield from reply(held)
                    held = []
                now = b
                held.append((at, blob))
        if held:
            yield from reply(held)

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    asked = spread(sets.select("bucket", F.lit(0).alias("kind"), F.col("tokens").alias("blob"))).mapInArrow(frequencies, PACKED)
    told_df = spread(asked).mapInArrow(answer, PACKED)

    def hyperedges(state: dict) -> Iterator[pa.RecordBatch]:
        """What a bucket's prefixes share: edges (kind 1), and a token's smallest key for the blocks of tokens (kind 0)."""
        if not state.get("tokens"):
            return
        h, d = np.concatenate(state["tokens"]), np.concatenate(state["keys"])
        state["tokens"], state["keys"] = [], []
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        least = d[new][np.cumsum(new) - 1]
        yield pack((h[new] % np.uint64(buckets)).astype(np.int64), 0, h[new], d[new])
        pairs = np.unique(np.column_stack([d[~new], least[~new]]), axis=0)
        if len(pairs):
            yield pack(np.mod(pairs[:, 0], buckets), 1, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    def rare_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, state, size = None, [], {"tokens": [], "keys": []}, 0
        known, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for bucket, kind, blob, k in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now:
                    now, blobs = bucket, []
                    known, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if kind == 0:
                    blobs.append(blob)
                    continue
                if blobs:
                    h, f = unpack(blobs, 2)
                    order = np.argsort(h)
                    known, df, blobs = h[order], f[order].view(np.int64), []
                tokens = np.frombuffer(blob, np.uint64)
                n = len(tokens)
                at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
                often = np.where(known[at] == tokens, df[at], 1) if len(known) else np.ones(n, np.int64)
                lacks = int(miss(np.array([n]), num, den)[0])
                alone = int((often == 1).sum())
                if alone > lacks:  # too few tokens that any other set has; a set that may lack none can still lie within a larger one
                    continue
                prefix = np.lexsort((tokens, often))[alone : lacks + 1]
                state["tokens"].append(tokens[prefix])
                state["keys"].append(np.full(len(prefix), k, np.int64))
                size += len(prefix)
                if size > 1 << 20:
                    yield from hyperedges(state)
                    size = 0
        yield from hyperedges(state)

    both = sets.select("bucket", F.lit(1).alias("kind"), F.col("tokens").alias("blob"), "k").unionByName(told_df.select("bucket", F.lit(0).alias("kind"), "blob", F.lit(None).cast("long").alias("k")))
    prefixed = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(rare_first, PACKED)

    def meet_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, zero, one in by_bucket(batches):
            found = []
            if one:
                found.append(np.column_stack([x.view(np.int64) for x in unpack(one, 2)]))
            if zero:
                h, d = unpack(zero, 2)
                order = np.lexsort((d.view(np.int64), h))
                h, d = h[order], d[order].view(np.int64)
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                found.append(np.column_stack([d[~new], d[new][np.cumsum(new) - 1][~new]]))
            e = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], names=["u", "v"])

    classes = keep.keep(components(spread(prefixed).mapInArrow(meet_tokens, "u long, v long"), keep))
    sizes = classes.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = sets.join(classes, F.col("k") == F.col("node")).join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))

    def meetings(rows: DataFrame, others) -> DataFrame:
        """A row for each pair of blocks (i <= j) in which a set of block b takes part; others: the blocks that b meets."""
        return rows.withColumn("o", F.explode(others)).select("component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "k", "tokens")

    blocks_of = F.sequence(F.lit(0), F.col("blocks") - 1)
    itself_and_first = F.when(F.col("b") == 0, blocks_of).otherwise(F.array(F.lit(0), F.col("b")))
    all_others = F.filter(F.sequence(F.lit(1), F.col("blocks") - 1), lambda o: o != F.col("b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(held: list[tuple[int, int, bytes]], i: int, j: int) -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0], x[1]))
            left = sum(b == i for b, *_ in held) if i != j else 0
            found = links([np.frombuffer(t, np.uint64) for *_, t in held], left, num, den) if len(held) > 1 and (i == j or 0 < left < len(held)) else []
            return pa.RecordBatch.from_arrays([pa.array([held[a][1] for a, _ in found], pa.int64()), pa.array([held[b][1] for _, b in found], pa.int64())], names=["u", "v"])

        now, held = None, []
        for batch in batches:
            for c, i, j, b, k, tokens in zip(*(batch.column(x).to_pylist() for x in range(6)), strict=True):
                if (c, i, j) != now:
                    if held:
                        yield group(held, *now[1:])
                    now, held = (c, i, j), []
                held.append((b, k, tokens))
        if held:
            yield group(held, *now[1:])

    def links_of(pairs: DataFrame) -> DataFrame:
        return pairs.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(verify, "u long, v long")

    found = links_of(meetings(placed, itself_and_first))
    if sizes.where("blocks > 1").limit(1).count():
        found = keep.keep(found)
        large = placed.where("blocks > 1").select(F.col("component").alias("class"), F.col("k").alias("node"))
        so_far = components(found.join(large.select(F.col("node").alias("u")), "u", "left_semi"), keep)
        ends = large.join(so_far, "node", "left").groupBy("class").agg(F.min(F.coalesce("component", "node")).alias("a"), F.max(F.coalesce("component", "node")).alias("z"))
        apart = keep.keep(ends.where("a <> z").select(F.col("class").alias("component")))
        found = found.unionByName(links_of(meetings(placed.where("blocks > 2 and b > 0").join(apart, "component", "left_semi"), all_others)))
    joined = components(found, keep)
    of_mark = keep.keep(heads.join(joined, F.col("head") == F.col("node"), "left").select("mark", F.coalesce("component", "head").alias("c"), "copies"))
    linked = join_common(marked.select("k", "n", "mark"), of_mark, ["mark"], "copies", told.count())
    out = linked.unionByName(told.where("mark is null").select("k", "n", "mark", F.col("k").alias("c"), F.lit(1).cast("long").alias("copies")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that link at a similarity of 0.85 of 4-word shingles."""
    return jaccard_components(documents(spark, sf_dir))


ORACLES = {
    "op6_jaccard_join": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + least(4, len(ws)) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id"""
}
