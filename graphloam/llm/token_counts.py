"""Token counts by a compiled finite-state tokenizer.

The byte-level BPE vocabulary is compiled, on demand, into a deterministic transducer over the bytes of a pretoken. Its
transitions carry the change of the number of emitted tokens, so a pretoken's count is the sum of the labels on its path.

Why that is finite: BPE of a byte string ends with exactly one token t, and the rest is BPE of what is before t; t is that
token if and only if t and the last token before it stay apart when the two are tokenized together. What a state has to
know is therefore the longest suffix that begins some token and, for each place in it where a token can begin, the last
token there and how the count there differs from the count here.

A long text is cut into chunks, and so is a long pretoken within. A chunk of a pretoken has a state map: from the state in
which the chunk is entered to the state in which it is left and the tokens in between. It is worked out from the start state,
chunk by chunk independently; another entry state runs only until it meets that path, as two paths that are in one state at
one place stay together. Maps compose associatively: a parallel prefix scan in a balanced tree, whose last element is the
pretoken's map. Chunks of a text compose likewise: a pretoken boundary that no neighbour can move (EDGE) parts a chunk's open
head and tail from the tokens between, which are the same for every entry state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from graphloam.llm.common import documents, small_batches, spread

# White space as the pattern's \s has it, and the pretokenizer's pattern.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Characters of a chunk.
CHUNK = 1 << 16
#: Bytes of a worker's memo of pretokens (longer ones than LONG characters are not kept), and entries of its transitions or
#: pairs; what is full starts anew.
MEMO, LONG, TRANSITIONS = 128 << 20, 64, 700_000
LIMIT = 1024


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of pretokens. State 0 is the start; states and transitions are made when first needed."""

    def __init__(self, tokenizer_file: str) -> None:
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        raw = lambda s: bytes(of[c] for c in s)
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if all(c in of for c in t)}
        self.rank = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[raw(a), raw(b)] = i
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.begins = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.find = regex.compile(PRETOKEN).findall
        self.memo: dict[str, int] = {}
        self.held = 0
        self._restart()

    def _restart(self) -> None:
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        # a state: (suffix, ((length of the suffix's suffix that begins a token, last token before it, count there less count here), ...))
        start = (b"", ((0, None, 0),))
        self.states, self.number = [start], {start: 0}
        self.next: dict[int, tuple[int, int]] = {}

    def bpe(self, word: bytes) -> list[bytes]:
        """Plain BPE: the pair of the least rank first, of equal ones the leftmost."""
        parts, rank, none = [word[i : i + 1] for i in range(len(word))], self.rank.get, 1 << 60
        pairs = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(pairs):
                pairs[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def stay_apart(self, a: bytes | None, b: bytes) -> bool:
        key = (a, b)
        if (known := self.apart.get(key)) is None:
            known = self.apart[key] = self.bpe((a or b"") + b) == ([b] if a is None else [a, b])
        return known

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        suffix, places = self.states[state]
        b = bytes([byte])
        grown, last, delta = [], None, 0
        for length, token, rel in places:
            piece = (suffix[len(suffix) - length :] if length else b"") + b
            if piece in self.begins:
                grown.append((length + 1, token, rel))
                if piece in self.tokens and self.stay_apart(token, piece):
                    last, delta = piece, rel + 1
        # counts are kept relative to the new position, which has `delta` tokens more than the old one
        places = ((0, last, 0), *((n, t, r - delta) for n, t, r in grown))
        longest = max((n for n, _, _ in places), default=0)
        new = ((suffix + b)[len(suffix) + 1 - longest :] if longest else b"", places)
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        self.next[state << 8 | byte] = to, delta
        return to, delta

    def count_pretoken(self, word: str) -> int:
        if len(self.next) > TRANSITIONS or len(self.apart) > TRANSITIONS:
            self._restart()
        raw = word.encode("utf-8", "replace")
        if len(raw) > CHUNK:
            maps = [StateMap(self, raw[i : i + CHUNK]) for i in range(0, len(raw), CHUNK)]
            while len(maps) > 1:
                maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            return maps[0](0)[1]
        return self.run(0, raw)[1]

    def run(self, state: int, raw: bytes) -> tuple[int, int]:
        """The state after the bytes, and the tokens that they add."""
        total, known = 0, self.next.get
        for byte in raw:
            state, delta = known(state << 8 | byte) or self._step(state, byte)
            total += delta
        return state, total

    def count_plain(self, text: str) -> int:
        """The tokens of a text without special strings."""
        found, memo, long_ = self.find(text), self.memo, {}
        if self.held > MEMO:
            memo.clear()
            self.held = 0
        for word in set(found):
            if word not in memo:
                if len(word) > LONG:
                    long_[word] = self.count_pretoken(word)
                else:
                    memo[word] = self.count_pretoken(word)
                    self.held += 140 + 2 * len(word)
        if long_:
            return sum(long_[w] if len(w) > LONG else memo[w] for w in found)
        return sum(map(memo.__getitem__, found))

    def count(self, text: str) -> int:
        """The tokens of a text; each special string is one token, wherever it stands."""
        if self.split is None:
            return self.count_long(text)
        parts = self.split.split(text)
        return sum(self.count_long(p) for p in parts[0::2]) + len(parts) // 2

    def count_long(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.count_plain(text) if text else 0
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.close(maps[0])

    # ------------------------------------------------------------------------------------------------- maps of chunks

    def chunk_map(self, text: str) -> ChunkMap:
        """The first and the last place where a pretoken ends whatever stands to the left or right part a chunk's head, middle
        and tail."""
        first = EDGE.search(text)
        if first is None:
            return ChunkMap((text,), None, ())
        back = len(text)
        while (cut := EDGE.search(text, max(0, back - 512), len(text))) is None:
            back -= 512
        cuts = [m.start() + 1 for m in EDGE.finditer(text, max(0, cut.start()))]
        head, tail = first.start() + 1, max(cuts[-1] if cuts else 0, first.start() + 1)
        return ChunkMap((text[:head],), self.count_plain(text[head:tail]) if tail > head else 0, (text[tail:],))

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.count is None and b.count is None:
            edge = EDGE.search(a.head[-1][-1:] + b.head[0][:1])
            return ChunkMap(a.head + b.head, None, ()) if edge is None else ChunkMap(a.head, 0, b.head)
        if a.count is None:
            return ChunkMap(a.head + b.head, b.count, b.tail)
        if b.count is None:
            return ChunkMap(a.head, a.count, a.tail + b.head)
        return ChunkMap(a.head, a.count + self.joined(a.tail + b.head) + b.count, b.tail)

    def joined(self, parts: tuple[str, ...]) -> int:
        """The tokens of what lies open between two edges."""
        text = "".join(parts)
        return self.count_plain(text) if text else 0

    def close(self, m: ChunkMap) -> int:
        return self.joined(m.head) + (m.count or 0) + self.joined(m.tail)


class StateMap:
    """A chunk of a pretoken as a map from entry states to (exit state, tokens)."""

    def __init__(self, t: Transducer, raw: bytes) -> None:
        self.t, self.raw = t, raw
        self.path, self.sums = [0], [0]
        state = total = 0
        for byte in raw:
            state, delta = t.next.get(state << 8 | byte) or t._step(state, byte)
            total += delta
            self.path.append(state)
            self.sums.append(total)
        self.known = {0: (state, total)}

    def __call__(self, entry: int) -> tuple[int, int]:
        if entry not in self.known:
            state, total = entry, 0
            for i, byte in enumerate(self.raw, 1):
                state, delta = self.t.next.get(state << 8 | byte) or self.t._step(state, byte)
                total += delta
                if state == self.path[i]:
                    state, total = self.path[-1], total + self.sums[-1] - self.sums[i]
                    break
            self.known[entry] = state, total
        return self.known[entry]


class Composed:
    """First one map, then another."""

    def __init__(self, first: StateMap | Composed, then: StateMap | Composed) -> None:
        self.first, self.then = first, then

    def __call__(self, entry: int) -> tuple[int, int]:
        between, n = self.first(entry)
        state, m = self.then(between)
        return state, n + m


class ChunkMap(NamedTuple):
    """What a chunk of a text does between its neighbours; the open parts are strings in pieces. count is None without an edge,
    when all of it is open."""

    head: tuple[str, ...]
    count: int | None
    tail: tuple[str, ...]


#: The character before a place where a pretoken ends, whatever stands around the two.
EDGE = regex.compile(rf"[^{WHITE}](?=[{WHITE}])|\p{{L}}(?=[^{WHITE}\p{{L}}])|\p{{N}}(?=[^{WHITE}\p{{N}}])|[^{WHITE}\p{{L}}\p{{N}}](?=\p{{N}})|[^{WHITE}\p{{L}}\p{{N}}'](?=\p{{L}})")


_compiled: dict[str, Transducer] = {}


def transducer(tokenizer_file: str) -> Transducer:
    """Compiled once in a worker."""
    if tokenizer_file not in _compiled:
        _compiled[tokenizer_file] = Transducer(tokenizer_file)
    return _compiled[tokenizer_file]


def token_counts(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row, without a shuffle. Null and empty texts have no tokens; keys may
    repeat or be null; other columns, of whatever name, are not read. Very long texts and pretokens are counted whole, chunk by
    chunk, in time in proportion to their length and within one task. An empty table gives no rows. There are no ties: a text has
    one count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(tokenizer_file)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [t.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode("utf-8", "replace")) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of documents under byte_bpe_50k.json."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
