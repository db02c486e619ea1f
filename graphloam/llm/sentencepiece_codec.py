"""SentencePiece encoding and decoding with a batched numpy Viterbi.

The vocabulary file at hand is a BPE model, and the result is the ids that its library gives. BPE fits a Viterbi lattice:
the BPE of a prefix ends with exactly one piece, and a piece may follow another if and only if the two stay apart when they
are merged together. So an arc of the lattice is a piece that ends here and stays apart from the best piece where it
begins; exactly one arc into each position lives, the maximum over the arcs finds it, and back pointers give the ids.

No piece has a space mark after another character, so words (space marks and what follows) are encoded one by one. New words
of a batch are grouped by length; all words of a group advance together by one character. Longer words (a text without spaces
is one) are cut into stretches that begin WARM characters early and advance together like words of one length; a stretch that
gives the same pieces as the one before it over a piece's length is exact from there on. Where a word has a stretch that does
not (a run of one character, say), the lattice goes through that word alone. Substrings are probed by their hash in the sorted
hashes of the pieces. Characters without a piece become the pieces of their UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloam.llm.common import documents, mix, small_batches, spread

MARK = "▁"
#: Bytes of the words that a worker remembers; longer words are not kept.
MEMO, LONG_WORD = 96 << 20, 64
#: Characters that a stretch of a long word adds, and those that it begins early; stretches that advance together.
STRETCH, WARM, TOGETHER = 512, 96, 1024
#: Slots of the cache of pairs of pieces, and of the table that rules out most substrings before their hash is searched.
PAIRS, MAYBE = 1 << 20, 1 << 21
#: Characters that are encoded together.
LOT = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Codec:
    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        check_model(sp.serialized_model_proto())
        n = sp.get_piece_size()
        self.bytes_at = next((i for i in range(n) if sp.is_byte(i)), None)
        self.unknown_id = sp.unk_id()
        self.score, self.piece, self.raw = {}, {}, [b""] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[p] = i
                self.score[p] = sp.get_score(i)
                self.raw[i] = p.replace(MARK, " ").encode()
        self.text = {i: p for p, i in self.piece.items()}
        self.longest = max(map(len, self.piece))
        self.none = n  # stands for a character without a piece
        names = list(self.piece)
        keys = np.concatenate([self._hash_rows(np.array([[ord(c) for c in p]], np.uint64)) for p in names])
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([self.piece[p] for p in names], np.int64)[order]
        self.maybe = np.zeros(MAYBE, bool)
        self.maybe[self.keys & np.uint64(MAYBE - 1)] = True
        self.pair_key, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.memo: dict[str, bytes] = {}  # word -> its ids, four bytes each
        self.held = 0

    @staticmethod
    def _hash_rows(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = h * _BASE + codes[:, j] + np.uint64(1)
        return mix(h + np.uint64(codes.shape[1]))

    def merge(self, text: str) -> list[str]:
        """Plain BPE, of pairs of pieces only: the best pair first, of equal ones the leftmost."""
        parts, score, none = list(text), self.score.get, -float("inf")
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) != none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def _apart(self, a: int, b: int) -> bool:
        """Whether piece b may follow a (a < 0: b begins the word)."""
        if self.none in (a, b):
            return b == self.none or self.merge(self.text[b]) == [self.text[b]]
        second = self.text[b]
        return self.merge(second) == [second] if a < 0 else self.merge(self.text[a] + second) == [self.text[a], second]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a + 1) * (self.none + 2) + b
        slot = (mix(key.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        ok, missing = self.pair_ok[slot], np.flatnonzero(self.pair_key[slot] != key)
        if len(missing):
            new, back = np.unique(key[missing], return_inverse=True)
            value = np.fromiter((self._apart(k // (self.none + 2) - 1, k % (self.none + 2)) for k in new.tolist()), bool, len(new))
            ok[missing] = value[back]
            self.pair_key[slot[missing]], self.pair_ok[slot[missing]] = key[missing], ok[missing]
        return ok

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """The pieces' ids, -1 for other substrings."""
        out = np.full(len(keys), -1, np.int64)
        rows = np.flatnonzero(self.maybe[keys & np.uint64(MAYBE - 1)])
        at = np.minimum(np.searchsorted(self.keys, keys[rows]), len(self.keys) - 1)
        same = self.keys[at] == keys[rows]
        out[rows[same]] = self.key_ids[at[same]]
        return out

    def lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of characters: the piece that ends at each place on the best path there, and its length."""
        n, length = codes.shape
        total = np.zeros((n, length + 1), np.uint64)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.longest, _BASE))), dtype=np.uint64)
        for j in range(length):
            total[:, j + 1] = total[:, j] * _BASE + codes[:, j] + np.uint64(1)
        last, step = np.full((n, length + 1), -1, np.int64), np.zeros((n, length + 1), np.int64)
        for i in range(1, length + 1):
            best, token, left = np.zeros(n, np.int64), np.full(n, self.none, np.int64), np.arange(n)
            for size in range(min(i, self.longest), 0, -1):  # the first arc that lives is the maximum: the longest
                ids = self._probe(mix(total[left, i] - total[left, i - size] * power[size] + np.uint64(size)))
                if size == 1:
                    ids[ids < 0] = self.none
                found = np.flatnonzero(ids >= 0)
                if len(found):
                    lives = found[self.apart(last[left[found], i - size], ids[found])]
                    best[left[lives]], token[left[lives]] = size, ids[lives]
                    if not len(left := np.delete(left, lives)):
                        break
            last[:, i], step[:, i] = token, best
        return last, step

    def viterbi(self, words: list[str]) -> list[bytes]:
        """The ids of words of one length, four bytes each."""
        n, length = len(words), len(words[0])
        last, step = self.lattice(_codes("".join(words)).reshape(n, length))
        # all words walk back together; ids fill a row from its end
        ids, at, begin = np.zeros((n, length), np.int32), np.full(n, length), np.full(n, length)
        live = np.arange(n)
        while len(live):
            begin[live] -= 1
            ids[live, begin[live]] = last[live, at[live]]
            at[live] -= np.maximum(1, step[live, at[live]])
            live = live[at[live] > 0]
        out = [row.tobytes()[4 * b :] for row, b in zip(ids, begin.tolist(), strict=True)]
        for r in np.flatnonzero((ids == self.none).any(1)).tolist():
            out[r] = self._with_bytes(words[r], ids[r, begin[r] :].tolist())
        return out

    def _with_bytes(self, word: str, tokens: list[int]) -> bytes:
        """The ids of a word's tokens, characters without a piece spelled in bytes."""
        out, i = [], 0
        for t in tokens:
            out += self._spelled(word[i]) if t == self.none else [t]
            i += 1 if t == self.none else len(self.text[t])
        return np.array(out, np.int32).tobytes()

    def _spelled(self, char: str) -> list[int]:
        """The ids of a character without a piece."""
        return [self.unknown_id] if self.bytes_at is None else [self.bytes_at + b for b in char.encode("utf-8", "replace")]

    def long_words(self, words: list[str]) -> list[bytes]:
        """The ids of words of any length, by stretches."""
        warm = max(WARM, 2 * self.longest)
        width, codes = STRETCH + warm, [_codes(w) for w in words]
        places = [(k, begin) for k, c in enumerate(codes) for begin in range(0, max(1, len(c) - warm), STRETCH)]
        tokens = [np.full(len(c) + 1, -1, np.int64) for c in codes]
        exact = [True] * len(words)
        for at in range(0, len(places), TOGETHER):
            part = places[at : at + TOGETHER]
            rows = np.full((len(part), width), _NO_CHARACTER, np.uint64)
            for r, (k, begin) in enumerate(part):
                own = codes[k][begin : begin + width]
                rows[r, : len(own)] = own
            last, _ = self.lattice(rows)
            for r, (k, begin) in enumerate(part):
                end = min(width, len(codes[k]) - begin)
                if begin:  # the stretch before has reached begin + warm
                    same = slice(warm - self.longest + 1, warm + 1)
                    exact[k] &= bool((last[r, same] == tokens[k][begin:][same]).all())
                    tokens[k][begin + warm + 1 : begin + end + 1] = last[r, warm + 1 : end + 1]
                else:
                    tokens[k][: end + 1] = last[r, : end + 1]
        return [self._walk(w, t.tolist()) if ok else self.alone(w) for w, t, ok in zip(words, tokens, exact, strict=True)]

    def _walk(self, word: str, last: list[int]) -> bytes:
        i, found = len(word), []
        while i > 0:
            found.append(last[i])
            i -= 1 if last[i] == self.none else len(self.text[last[i]])
        return self._with_bytes(word, found[::-1])

    def alone(self, word: str) -> bytes:
        """The same lattice for one word, place by place."""
        last = [-1] * (len(word) + 1)
        known: dict[tuple[int, int], bool] = {}
        for i in range(1, len(word) + 1):
            for size in range(min(i, self.longest), 0, -1):
                t = self.piece.get(word[i - size : i], self.none if size == 1 else -1)
                if t < 0:
                    continue
                pair = last[i - size], t
                if pair not in known:
                    known[pair] = bool(self.apart(np.array([pair[0]]), np.array([t]))[0])
                if known[pair]:
                    last[i] = t
                    break
        return self._walk(word, last)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Encodes the words that are new; returns those that are too long to be kept."""
        if self.held > MEMO:
            self.memo.clear()
            self.held = 0
        new = words.difference(self.memo) if self.memo else words
        by: dict[int, list[str]] = {}
        long_ = []
        for w in new:
            if len(w) > LONG_WORD:
                long_.append(w)
            else:
                by.setdefault(len(w), []).append(w)
        for group in by.values():
            for i in range(0, len(group), 20_000):
                part = group[i : i + 20_000]
                self.memo.update(zip(part, self.viterbi(part), strict=True))
                self.held += len(part) * (200 + 4 * len(part[0]))
        return dict(zip(long_, self.long_words(long_), strict=True)) if long_ else {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        long_ = self.learn(set().union(*split))
        if not long_:
            return [np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.int32) for words in split]
        return [np.frombuffer(b"".join([long_[w] if len(w) > LONG_WORD else self.memo[w] for w in words]), np.int32) for words in split]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


#: Stands for no character behind the end of a word.
_NO_CHARACTER = np.uint64(0x110000)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer: a number, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + size]
            at += size


def check_model(serialised: bytes) -> None:
    """Raises for a model that this lattice would encode otherwise than its library: one that is not of the type BPE, or one
    that normalises texts in another way than by a space before and marks for spaces."""
    # Field numbers of the model's messages, and their defaults.
    model = dict(_fields(serialised))
    trainer, normaliser = dict(_fields(model.get(2, b""))), dict(_fields(model.get(3, b"")))
    if trainer.get(3, 1) != 2:
        raise ValueError("only models of the type BPE")
    if normaliser.get(2, b"") or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        raise ValueError("only models without a normalisation of their own")


WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encode(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_ids, n_tokens, round_trip) for every row, without a shuffle; round_trip: decoding gives the text again.

    Null and empty texts have no ids. Keys may be null and repeat; other columns, of whatever name, are not read; an empty table
    gives no rows. Very long texts and words are encoded whole, in time in proportion to their length. Ties of BPE go to the
    leftmost pair, as in the library. A text with the space mark itself is encoded as the library does, which decodes it as
    a space: round_trip is false there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            begin = size = 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1])
                if size > LOT or end == len(texts):
                    part = texts[begin:end]
                    ids = c.encode(part)
                    flat = np.concatenate(ids)
                    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[begin:end], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([len(x) for x in ids], pa.int64()), pa.array([c.decode(x.tolist()) == t for x, t in zip(ids, part, strict=True)], pa.bool_())],
                        names=[key, "token_ids", "n_tokens", "round_trip"],
                    )
                    begin, size = end, 0

    small_batches(docs.sparkSession)
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, token_ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, model_file: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(key, text) of encoded rows. Null ids give null, no ids an empty text, ids outside the vocabulary and nulls among the ids
    nothing. Keys may repeat or be null; very long lists are decoded whole. An empty table gives no rows; other columns, of
    whatever name, are not read. There are no ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            texts = [None if x is None else c.decode([i for i in x if i is not None and 0 <= i < len(c.raw)]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    small_batches(encoded.sparkSession)
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document under piece_bpe_32k.model, and whether they decode to the text."""
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
