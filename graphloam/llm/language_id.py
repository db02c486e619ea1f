"""Language identification with a bit-sliced Bloom filter of n-grams.

Each language has a set of character n-grams. One table of machine words holds the Bloom filters of all languages, a bit
for each language: the AND of an n-gram's slots is the mask of all languages that (may) contain it. A text's n-grams give
each language a popcount, which is corrected once for the filter's false positives, and the largest corrected count decides.

The sets come from a bounded sample: PER_LANGUAGE training documents of each language in expectation, chosen by a hash of
their key, with whole texts, and all of their n-grams; the filter's size follows from their number. An n-gram that a language has much more
seldom than another one is left out of its set, as quotations and wrong labels bring such n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.llm.common import PASS_BYTES, documents, mix, small_batches, spread

PER_LANGUAGE, SELDOM = 2000, 0.05
#: Slots of the filter at least, and for each n-gram of the language that has most (rounded up to a power of two); probes.
SLOTS, ROOM, PROBES = 1 << 18, 8, 3
UNDETERMINED = "und"


_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """By code point."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' trigrams in lower case, all other characters as a boundary, one for each letter as its middle;
    and where each text's begin (one entry more than texts)."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = is_letter()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    middle = np.flatnonzero(letter)
    out = mix(codes[middle - 1] | codes[middle] << np.uint64(21) | codes[middle + 1] << np.uint64(42))
    begins = np.cumsum([1, *(len(t) + 1 for t in lower)])
    return out, np.searchsorted(middle, begins)


class Filters:
    """languages[b] is the language of bit b; languages beyond 64 take further words of a slot."""

    def __init__(self, grams: dict[str, np.ndarray], slots: int | None = None, probes: int = PROBES) -> None:
        slots = slots or max(SLOTS, 1 << (ROOM * max(map(len, grams.values()), default=0)).bit_length())
        self.languages, self.slots, self.probes = sorted(grams), slots, probes
        self.table = np.zeros((max(1, -(-len(grams) // 64)), slots), np.uint64)
        fill = np.zeros(len(self.languages))
        for b, language in enumerate(self.languages):
            for at in self._places(grams[language]):
                np.bitwise_or.at(self.table[b // 64], at, np.uint64(1 << b % 64))
            fill[b] = np.count_nonzero(self.table[b // 64] & np.uint64(1 << b % 64)) / slots
        self.false = fill**probes

    def _places(self, hashes: np.ndarray) -> list[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [((hashes + np.uint64(i) * step) & np.uint64(self.slots - 1)).astype(np.int64) for i in range(self.probes)]

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits."""
        places = self._places(hashes)
        out = self.table[:, places[0]]
        for at in places[1:]:
            out = out & self.table[:, at]
        return out

    def popcounts(self, hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many n-grams each language (may) have, a row for each text and a column for each language; and the numbers of
        n-grams."""
        masks, n = self.masks(hashes), np.diff(begins)
        counts = np.zeros((len(n), len(self.languages)))
        for b in range(len(self.languages)):
            total = np.concatenate(([0], np.cumsum((masks[b // 64] >> np.uint64(b % 64)) & np.uint64(1), dtype=np.int64)))
            counts[:, b] = total[begins[1:]] - total[begins[:-1]]
        return counts, n

    def corrected(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Without the false positives that are expected among n n-grams."""
        return np.maximum(0, (counts - n[:, None] * self.false) / (1 - self.false))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """score: the decided language's share of all corrected counts. Ties, and texts without any known n-gram (score 0),
        go to the first language in alphabetical order; texts without a letter are undetermined."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        counts, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for owner, *grams in gram_lots(texts):
            c, m = self.popcounts(*grams)
            np.add.at(counts, owner, c)
            np.add.at(n, owner, m)
        counts = self.corrected(counts, n)
        best, total = counts.argmax(1), counts.sum(1)
        score = np.where(total > 0, counts[np.arange(len(texts)), best] / np.maximum(total, 1e-300), 0.0)
        return [self.languages[b] if m else UNDETERMINED for b, m in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, score, 0.0).tolist()


def gram_lots(texts: list[str], most: int = PASS_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' trigrams some `most` characters at a time: (number of each piece's text, hashes, where each piece's begin). A
    long text is cut into pieces that overlap by a character on both sides; a trigram belongs to the piece that has its middle,
    so the pieces' trigrams are the text's, wherever it is cut."""
    pieces, size = [], 0
    for i, t in enumerate(texts):
        for begin in range(0, max(1, len(t)), most):
            piece = t[max(0, begin - 1) : begin + most + 1]
            pieces.append((i, piece, begin > 0, begin + most < len(t)))
            size += len(piece)
            if size > most:
                yield _piece_grams(pieces)
                pieces, size = [], 0
    if pieces:
        yield _piece_grams(pieces)


def _piece_grams(pieces: list[tuple[int, str, bool, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, begins = trigrams([p for _, p, *_ in pieces])
    # a lower-cased character may be several, so the borrowed ones are counted after that
    letter = is_letter()
    drop, own = np.zeros(len(hashes), bool), np.zeros(len(pieces), np.int64)
    for k, (_, p, left, right) in enumerate(pieces):
        s, e = begins[k], begins[k + 1]
        if left:
            n = int(letter[[ord(c) for c in p[0].lower()]].sum())
            drop[s : s + n] = True
        if right:
            n = int(letter[[ord(c) for c in p[-1].lower()]].sum())
            drop[e - n : e] = True
        own[k] = e - s - drop[s:e].sum()
    return np.array([i for i, *_ in pieces]), hashes[~drop], np.concatenate(([0], np.cumsum(own)))


def fit(labelled: DataFrame, key: str, text: str, lang: str, per_language: int = PER_LANGUAGE, seldom: float = SELDOM) -> Filters:
    """Filters from rows with text and language. Without such rows there are no languages, and every text is undetermined.
    Rows that repeat a key are in the sample together or not at all."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    share = {r["l"]: min(1.0, per_language / r["n"]) for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return Filters({})
    chance = F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(chance < F.element_at(F.create_map(*(F.lit(x) for kv in share.items() for x in kv)), F.col("l"))).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(language, []).append(t)
            for language, texts in by.items():
                for _, grams, _ in gram_lots(texts):
                    held.setdefault(language, []).append(np.unique(grams, return_counts=True))
        for language, parts in held.items():
            g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(g)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["l", "g", "n"])

    small_batches(labelled.sparkSession)
    counts = sample.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    table = counts.select("l", "g", "n").toPandas()  # of the sample's texts, whose number is bounded
    table["p"] = table.n / table.groupby("l").n.transform("sum")
    table = table[table.p >= seldom * table.groupby("g").p.transform("max")]
    return Filters({language: x.g.to_numpy(np.int64).view(np.uint64) for language, x in table.groupby("l")} | {language: np.zeros(0, np.uint64) for language in share if language not in set(table.l)})


def predict(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row, from the text alone, without a shuffle. Null texts and those without a letter
    get `und` and 0; keys may repeat or be null. Very long texts are counted whole, a million characters at a time. Ties go to
    the first language in alphabetical order. Other columns, of whatever name, are not read; an empty table gives no rows. The
    filters' size follows from the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = filters.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents; learned from those whose crc32(doc_id as text) mod 3 is not 1. A null doc_id is neither
    learned from nor held out."""
    docs = documents(spark, sf_dir)
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    filters = fit(docs.where(third != 1), "doc_id", "text", "lang")
    out = predict(docs, filters)
    return out.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
