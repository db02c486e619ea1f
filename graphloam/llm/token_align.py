"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Python only tokenises: documents come in lots, and for the distinct words of a lot it gives the ids of both tokenizers, for the
distinct shapes of these words (the lengths of a word's tokens under both) the byte offsets where the tokens end, and for each
document the numbers of its words. A word's end is an end of both tokenizers, so a word has its groups and links to itself, and
they depend on its shape. Everything after that is Spark's higher-order functions over these arrays:

* Shapes are aligned, and words get their ids in place of a shape's places. The ends of both are merged (two sorted runs) with each token's number packed in. In merged order every distinct end closes
  one stretch of bytes that lies in exactly one token of either side, so the stretches are the links; a token's place less its
  number is the number of tokens of the other side before it. Two equal ends cut the tokens into groups. All of it is transforms
  over one array, linear in its length.
* The words that are often in a sample of the documents are aligned once and broadcast; a lot aligns its other words only.
* A document's groups and links are those of its words, in order.
* A link's pair of ids is counted by documents: distinct pairs are exploded and counted with map-side partial sums.

The counts come back by a broadcast of the pairs that more than one HOT-th of all (document, pair) rows have - fewer than HOT
by that - and by a join on the pair for the rest, each of which has few rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloam.llm.common import Durable, documents, lots, small_batches, spread
from graphloam.llm.sentencepiece_codec import MARK, check_model
from graphloam.llm.token_counts import byte_alphabet

#: Pairs that are broadcast are fewer than this.
HOT = 1 << 18
#: Bytes of texts whose distinct words are aligned together. A longer text is a lot of its own.
LOT = 3 << 20
#: Bytes of a worker's memo of words, and about what a word takes besides its characters and tokens; words that go to a library at once.
MEMO, WORD, CALL = 128 << 20, 230, 16_384
#: Words that are aligned ahead, at most, and how often they are in the sample that they are chosen from, at least; bytes of files in
#: the sample, at most and as a share; bytes of an input that has one, at least.
OFTEN, TIMES = 1 << 17, 4
SAMPLE, SHARE, LEAST = 32 << 20, 1 / 16, 16 << 20
#: Words of a text with a space before it: a word ends where something that is no white space stands before a space.
WORDS = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*").findall


class Side:
    """One tokenizer. raw: the bytes of each id's token; together: the ids of a text that begins with a space."""

    def __init__(self, raw: list[bytes]) -> None:
        self.raw, self.size = raw, np.array([len(r) for r in raw], np.int64)

    def together(self, text: str) -> list[int]:
        raise NotImplementedError

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all words, how many each word has, and which words the tokens give back byte by byte. Words that end with white
        space (the last of a text) would run into the next, and are tokenised alone."""
        raw = [w.encode("utf-8", "replace") for w in words]
        alone = np.fromiter((w[-1:].isspace() for w in words), bool, len(words))
        n, good = np.zeros(len(words), np.int64), np.ones(len(words), bool)
        joined = np.flatnonzero(~alone)
        ids = np.array(self.together("".join(words[i] for i in joined.tolist())) if len(joined) else [], np.int32)
        ends = np.cumsum(self.size[ids])
        stop = np.cumsum(np.fromiter((len(raw[i]) for i in joined.tolist()), np.int64, len(joined)))
        at = np.searchsorted(ends, stop, side="right")
        if len(joined) and not (at[-1] == len(ids) and (at > 0).all() and (ends[at - 1] == stop).all() and b"".join(map(self.raw.__getitem__, ids.tolist())) == b"".join(raw[i] for i in joined.tolist())):
            alone[:] = True
            at, ids = np.zeros(len(joined), np.int64), ids[:0]
        n[joined] = np.diff(at, prepend=0)
        own = {i: self.together(words[i]) for i in np.flatnonzero(alone).tolist()}
        for i, found in own.items():
            n[i], good[i] = len(found), b"".join(map(self.raw.__getitem__, found)) == raw[i]
        if own:  # put in their places
            all_ids, first = np.empty(int(n.sum()), np.int32), np.cumsum(n) - n
            all_ids[np.repeat(~alone, n)] = ids
            for i, found in own.items():
                all_ids[first[i] : first[i] + len(found)] = found
            ids = all_ids
        return ids, n, good


class ByteLevel(Side):
    """A byte-level BPE in the tokenizers library's format. A pretoken ends where something that is no white space stands before
    a space, whatever is around the two."""

    def __init__(self, path: str) -> None:
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        of = byte_alphabet()
        tokens = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        super().__init__([bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in tokens])

    def together(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces(Side):
    """A sentencepiece BPE model, which puts a space before the text itself. A piece has no space mark after another character,
    so a word's pieces don't depend on the words around it."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(sp.serialized_model_proto())
        super().__init__([bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())])
        self.space = sp.piece_to_id(MARK)

    def together(self, text: str) -> list[int]:
        return self.library.encode(text[1:]) if len(text) > 1 else [self.space]


def words_of(texts: list[str]) -> list[list[str]]:
    return [WORDS(" " + t) if t and MARK not in t else [] for t in texts]


def often(docs: DataFrame, text: str) -> list[str]:
    """The most frequent words of a sample. They are only aligned ahead: any list gives the same rows."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < LEAST:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for words in words_of([(x or b"").decode("utf-8", "replace") for x in batch.column(0).cast(pa.binary()).to_pylist()]):
                found.update(words)
            if len(found) > OFTEN or not batch.num_rows:
                yield counted(found)
                found.clear()
        yield counted(found)

    def counted(found: Counter[str]) -> pa.RecordBatch:
        kept = {w: n for w, n in found.items() if len(w) <= 64}
        return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

    small_batches(docs.sparkSession)
    counts = docs.select(text).sample(min(SHARE, SAMPLE / size), seed=11).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.where(F.col("n") >= TIMES).orderBy(F.desc("n"), "word").limit(OFTEN).select("word").collect()]


class Both:
    """Two tokenizers over the same words. Words are numbered as they come, and their ids remembered; the words that are aligned
    ahead have the first numbers, and stay."""

    def __init__(self, a_file: str, b_file: str, ahead: list[str]) -> None:
        self.sides = ByteLevel(a_file), Pieces(b_file)
        self.number: dict[str, int] = {}
        self.good, self.lots, self.held = np.zeros(0, bool), np.zeros(0, np.int32), 0
        self.ids, self.n = [np.zeros(0, np.int32) for _ in self.sides], [np.zeros(0, np.int64) for _ in self.sides]
        self.shapes: dict[bytes, int] = {}
        self.shape = np.zeros(0, np.int64)
        self.ahead = len(ahead)
        if ahead:
            self.learn(ahead)

    def forget(self, keep: np.ndarray) -> None:
        """All words but those of these numbers (in order)."""
        names = list(self.number)
        self.ids = [self.tokens(i, keep) for i in range(2)]
        self.n, self.good, self.lots = [n[keep] for n in self.n], self.good[keep], self.lots[keep] // 2
        self.number = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.shapes = {}
        self.shape = self.shaped(self.ids, self.n, self.good)
        self.held = sum(map(len, self.number)) + WORD * len(keep) + 4 * sum(map(len, self.ids))

    def tokens(self, side: int, words: np.ndarray) -> np.ndarray:
        """The ids of these words one after the other."""
        n = self.n[side]
        first, own = (np.cumsum(n) - n)[words], n[words]
        return self.ids[side][np.repeat(first - np.cumsum(own) + own, own) + np.arange(own.sum())]

    def shaped(self, ids: list[np.ndarray], n: list[np.ndarray], good: np.ndarray) -> np.ndarray:
        """The numbers of words' shapes. A shape is a's number of tokens and the lengths of a's and b's tokens."""
        data = [side.size[x].astype(np.int32).tobytes() for side, x in zip(self.sides, ids, strict=True)]
        stop = [np.cumsum(4 * x) for x in n]
        cuts = [map(slice, (s - 4 * x).tolist(), s.tolist()) for s, x in zip(stop, n, strict=True)]
        count, odd = n[0].astype(np.int32).tobytes(), np.array([1, 1, 1], np.int32).tobytes()  # of words that no text keeps
        found = (count[4 * i : 4 * i + 4] + data[0][a] + data[1][b] if g else odd for i, (a, b, g) in enumerate(zip(*cuts, good.tolist(), strict=True)))
        return np.fromiter((self.shapes.setdefault(x, len(self.shapes)) for x in found), np.int64, len(good))

    def learn(self, words: list[str]) -> None:
        good, new_ids, new_n = np.ones(len(words), bool), [], []
        for i, side in enumerate(self.sides):
            found = [side.words(words[k : k + CALL]) for k in range(0, len(words), CALL)]
            new_ids.append(np.concatenate([f[0] for f in found]))
            new_n.append(np.concatenate([f[1] for f in found]))
            good &= np.concatenate([f[2] for f in found])
        self.shape = np.concatenate([self.shape, self.shaped(new_ids, new_n, good)])
        self.ids, self.n = [[np.concatenate(x) for x in zip(*y, strict=True)] for y in ((self.ids, new_ids), (self.n, new_n))]
        self.held += sum(map(len, words)) + WORD * len(words) + 8 * sum(map(len, new_ids))
        self.good, self.lots = np.concatenate([self.good, good]), np.concatenate([self.lots, np.zeros(len(words), np.int32)])
        self.number.update(zip(words, range(len(self.number), len(self.good)), strict=True))

    def lot(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words; how many words each text has: none where a tokenizer does not give the text's bytes. (A
        space mark in a text comes back as a space.)"""
        if self.held > MEMO:  # half of it at most is kept, of the words that several lots had
            first, rest = np.arange(self.ahead), self.lots[self.ahead :]
            most = np.argsort(-rest, kind="stable")[: len(rest) // 2]
            self.forget(np.concatenate([first, self.ahead + np.sort(most[rest[most] > 1])]))
            if self.held > MEMO // 2:
                self.forget(first)
        cut = words_of(texts)
        every, size = list(chain.from_iterable(cut)), np.fromiter(map(len, cut), np.int64, len(cut))
        if new := list(set(every).difference(self.number)):
            self.learn(new)
        words = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        bad = ~self.good[words]
        if bad.any():
            text = np.repeat(np.arange(len(size)), size)
            whole = np.bincount(text[bad], minlength=len(size)) == 0
            words, size = words[whole[text]], np.where(whole, size, 0)
        return words, size


_loaded: dict[tuple, Both] = {}


def both(a_file: str, b_file: str, ahead: list[str]) -> Both:
    """Loaded once in a worker, for one list of words at a time."""
    key = a_file, b_file, hash(tuple(ahead)), len(ahead)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Both(a_file, b_file, ahead)
    return _loaded[key]


# Without nulls in them, so that Spark sorts and looks up plain numbers.
_INTS, _LONGS, _FLAGS = (T.ArrayType(t, False) for t in (T.IntegerType(), T.LongType(), T.BooleanType()))


_TABLE = {"a": _INTS, "a_end": _LONGS, "last": _FLAGS, "b": _INTS, "b_end": _LONGS, "first": _INTS, "n": _INTS, "ids": _INTS, "at": _INTS, "shape": _INTS}


def table(t: Both, words: np.ndarray) -> list[pa.Array]:
    """The columns of _TABLE for these words: one row. ids: a's and then b's of every word (and two more); at: where each word's
    begin; shape: its number among the distinct shapes. Of these, one after the other: a, a_end, b, b_end: the places of the tokens
    among a word's ids and their end offsets in bytes (offset * 2^32 + the token's number); last: whether a token of a is its
    word's last; first, n: the tokens of both before and in each shape."""
    used, shape = np.unique(t.shape[words], return_inverse=True)
    names = list(t.shapes)
    chosen = [names[i] for i in used.tolist()]
    data, whole = np.frombuffer(b"".join(chosen), np.int32), np.array([len(x) // 4 for x in chosen], np.int64)
    begin = np.cumsum(whole) - whole
    n, n_a = whole - 1, data[begin].astype(np.int64)
    place = np.arange(len(data)) - np.repeat(begin, whole) - 1
    of_a, of_b = (place >= 0) & (place < np.repeat(n_a, whole)), place >= np.repeat(n_a, whole)
    last = np.zeros(int(n_a.sum()), bool)
    last[np.cumsum(n_a) - 1] = True
    ends = [np.cumsum(data[x], dtype=np.int64) << 32 | np.arange(x.sum()) for x in (of_a, of_b)]
    sizes = [x[words] for x in t.n]
    at = np.cumsum(sizes[0] + sizes[1]) - sizes[0] - sizes[1]
    ids = np.zeros(int(sizes[0].sum() + sizes[1].sum()) + 2, np.int32)
    for i, start in enumerate((at, at + sizes[0])):
        own = sizes[i]
        ids[np.repeat(start - np.cumsum(own) + own, own) + np.arange(own.sum())] = t.tokens(i, words)
    types = [to_arrow_type(x) for x in _TABLE.values()]
    values = place[of_a], ends[0], last, place[of_b], ends[1], np.cumsum(n) - n, n, ids, at, shape
    return [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, x.value_type), type=x) for v, x in zip(values, types, strict=True)]


def tokenised(docs: DataFrame, a_file: str, b_file: str, ahead: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each lot of documents. docs: (key, n_a, n_b, words) of each, words as places in `ahead` followed by the lot's other
    distinct ones, n_a and n_b its tokens; no words where the text is null or empty, or where the tokens of one side have other
    bytes than space + text. The other columns are table()'s for those other words."""
    kind = docs.schema[key].dataType
    doc = T.StructType([T.StructField("key", kind), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("words", _INTS)])
    columns = {"docs": T.ArrayType(doc, False)} | _TABLE
    all_docs, one_doc = to_arrow_type(columns["docs"]), to_arrow_type(doc)

    def made(t: Both, keys: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        words, size = t.lot([x.decode("utf-8", "replace") for x in texts])
        stop = np.concatenate(([0], np.cumsum(size)))
        tokens = [np.diff(np.concatenate(([0], np.cumsum(n[words])))[stop]) for n in t.n]
        own = np.zeros(len(t.good), bool)
        own[words] = True
        own[: t.ahead] = True
        place = (np.cumsum(own) - 1)[words]
        distinct = np.flatnonzero(own)
        t.lots[distinct] += 1
        of_words = pa.ListArray.from_arrays(pa.array(stop.astype(np.int32)), pa.array(place.astype(np.int32)), type=one_doc.field("words").type)
        rows = pa.StructArray.from_arrays([pa.concat_arrays(keys).cast(one_doc.field("key").type), *(pa.array(n, pa.int64()) for n in tokens), of_words], fields=list(one_doc))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows, type=all_docs), *table(t, distinct[t.ahead :])], names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = both(a_file, b_file, ahead)
        keys, texts, held = [], [], 0
        for batch in batches:
            for begin, part in lots([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], LOT):
                size = sum(map(len, part))
                if texts and held + size > LOT:
                    yield made(t, keys, texts)
                    keys, texts, held = [], [], 0
                keys.append(batch.column(0)[begin : begin + len(part)])
                texts += part
                held += size
        if texts:
            yield made(t, keys, texts)

    small_batches(docs.sparkSession)
    return spread(docs.select(key, text)).mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in columns.items()]))


# A packed end: the offset, one bit for the side that comes second, and the token's number.
_NUMBER, _SIDE = "2147483647L", "2147483648L"
_I = f"int(x & {_NUMBER})"
_FIRST = f"x & {_SIDE} = 0"
#: An end of the second side after an equal one of the first.
_TIE = "p > 0 AND shiftright({0}[p - 1], 31) + 1 = shiftright(x, 31)"


def aligned(tokens: DataFrame, *others: str) -> DataFrame:
    """(lists, links) of each row with the columns of _TABLE, by its words: lists are `a1,a2|b1;a3|b2,b3` (ids in order), one more
    than words; links the pairs of linked ids (a * 2^31 + b), one for each link. Both are made for the shapes first, with
    places in place of ids. What a lambda looks up is used twice in its
    step at least, so that the planner keeps it as a column and does not work it out for each element.

    The ends are merged in both orders, so that an end of the other side follows where a group ends; it stands for the edge of
    the group (-1; -2 after b's last token of a word) among a side's ids."""
    merged = tokens.select(
        *others, "ids", "at", "shape", "a", "b", "last", "first", "n",
        F.expr(f"sort_array(concat(a_end, transform(b_end, x -> x | {_SIDE})))").alias("merged"),
        F.expr(f"sort_array(concat(transform(a_end, x -> x | {_SIDE}), b_end))").alias("turned"),
    )
    of_a = f"transform(merged, (x, p) -> if({_FIRST}, a[{_I}], if({_TIE.format('merged')}, -1, null)))"
    of_b = f"transform(turned, (x, p) -> if({_FIRST}, b[{_I}], if({_TIE.format('turned')}, if(last[{_I}], -2, -1), null)))"
    lists = lambda ids: f"array_join(cast({ids} AS array<string>), ',')"
    flat = merged.select(
        *others, "ids", "at", "shape", "first", "n",
        F.expr(f"split(replace({lists(of_a)}, ',-1', '|/'), '/')").alias("a_groups"),
        F.expr(f"split(replace(replace({lists(of_b)}, ',-1', ';/'), ',-2', '#/'), '/')").alias("b_groups"),
        # a link for every distinct end; the second of two equal ends closes a group instead
        F.expr(f"transform(merged, (x, p) -> if({_FIRST}, shiftleft(bigint(a[{_I}]), 31) | b[p - {_I}], if({_TIE.format('merged')}, null, shiftleft(bigint(a[p - {_I}]), 31) | b[{_I}])))").alias("flat"),
    )
    shapes = flat.select(
        *others, "ids", "at", "shape",
        F.expr("split(replace(replace(replace(array_join(flatten(zip_with(a_groups, b_groups, (x, y) -> array(x, y))), ''), '|,', '|'), ';,', ';'), '#,', '#'), '#')").alias("of_shape"),
        F.expr("transform(first, (f, k) -> filter(transform(sequence(f, least(f + n[k], size(flat)) - 1), p -> flat[p]), x -> x IS NOT NULL))").alias("pairs"),
    ).select(*others, "ids", "at", "shape", "pairs", F.expr("transform(slice(of_shape, 1, size(of_shape) - 1), x -> cast(split(concat(replace(replace(x, '|', ',-1,'), ';', ',-2,'), ',-3'), ',') AS array<int>))").alias("codes"))
    words = "array_join(cast(flatten(transform(at, (f, k) -> transform(codes[least(shape[k], size(codes))], c -> if(c < 0, c, ids[f + c])))) AS array<string>), ',')"
    return shapes.select(
        *others,
        F.expr(f"split(replace(replace(replace(concat({words}, ','), ',-1,', '|'), ',-2,', ';'), ',-3,', '#'), '#')").alias("lists"),
        F.expr(f"transform(at, (f, k) -> transform(pairs[least(shape[k], size(pairs))], c -> shiftleft(bigint(ids[f + int(shiftright(c, 31))]), 31) | ids[f + int(c & {_NUMBER})]))").alias("links"),
    )


def align(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text", keep: Durable | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups, links) for every row: groups is `a1,a2|b1;a3|b2,b3` (ids in order), links are
    the pairs of linked ids (a * 2^31 + b), one for each link; see tokenised() and aligned().

    Null and empty texts, and those whose tokens have other bytes than the text (a space mark in it, bytes that a vocabulary
    lacks), have no tokens: zeros, an empty string and an empty array. Keys may repeat or be null: rows are aligned one by one.
    Very long texts are aligned whole. Ties (both tokenizers end at one offset) are what cuts groups. An empty table gives no
    rows. Other columns, of whatever name, are not read.
    """
    spark = docs.sparkSession
    ahead = often(docs, text)
    words = aligned(tokenised(docs, a_file, b_file, ahead, key, text), "docs")
    if ahead:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _ in range(batch.num_rows):
                    yield pa.RecordBatch.from_arrays(table(both(a_file, b_file, ahead), np.arange(len(ahead))), names=list(_TABLE))

        one = spark.range(1, numPartitions=1).mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in _TABLE.items()]))
        known = (keep or Durable(spark)).keep(aligned(one).select(F.slice("lists", 1, len(ahead)).alias("lists_ahead"), F.col("links").alias("links_ahead")))
        words = words.crossJoin(F.broadcast(known)).select("docs", F.concat("lists_ahead", "lists").alias("lists"), F.concat("links_ahead", "links").alias("links"))
    found = words.select(F.explode(F.expr("transform(docs, d -> struct(d.key AS key, d.n_a AS n_a, d.n_b AS n_b, array_join(transform(d.words, w -> lists[w]), ';') AS groups, flatten(transform(d.words, w -> links[w])) AS links))")).alias("d"))
    n = F.size("d.links").cast("long")
    return found.select(F.col("d.key").alias(key), "d.n_a", "d.n_b", (F.col("d.n_a") + F.col("d.n_b") - n).alias("n_groups"), n.alias("n_links"), "d.groups", "d.links")


def pair_counts(rows: DataFrame, keep: Durable) -> DataFrame:
    """(pair, a, n, best) from rows with links: n rows have the pair; best: no pair of the same a has more."""
    n = keep.keep(rows.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.shiftright("pair", 31).cast("int")))
    top = n.groupBy("a").agg(F.max("n").alias("top"))  # as many rows as the vocabulary at most
    return keep.keep(n.join(F.broadcast(top), "a").select("pair", "a", "n", (F.col("n") == F.col("top")).alias("best")))


def with_counts(rows: DataFrame, hot: int = HOT, keep: Durable | None = None) -> DataFrame:
    """rows (with links, as align() gives them) with n_best and count_sum in their place. Every row counts as one document."""
    keep = keep or Durable(rows.sparkSession)
    rest = [c for c in rows.columns if c != "links"]
    row = "_" * (1 + max(map(len, rows.columns)))  # a name that no column has
    stored = keep.keep(rows.withColumn(row, F.monotonically_increasing_id()))
    counts = pair_counts(stored, keep)
    total, pairs = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    many = F.col("n") * hot > F.lit(total)
    common = counts.where(many) if pairs >= hot else counts
    each = stored.select(row, F.explode("links").alias("pair"))
    sums = [F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum")]
    found = each.join(F.broadcast(common.select("pair", "n", "best")), "pair").groupBy(row).agg(*sums)
    if pairs >= hot:
        rare = each.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(counts.where(~many).select("pair", "n", "best").hint("merge"), "pair").groupBy(row).agg(*sums)
        found = found.unionByName(rare).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = stored.select(*(F.col(f"`{c}`") for c in rest), row).join(found, row, "left")
    return joined.select(*(F.col(f"`{c}`") for c in rest), F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"), F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of byte_bpe_50k.json and piece_bpe_32k.model over every document."""
    import public_tokenizers

    rows = align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    return with_counts(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"))
