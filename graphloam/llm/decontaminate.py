"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

An item is contained in a document when at least THRESHOLD of the item's distinct shingles of K words stand in it. A
MinHash signature of a long document says little about a short item, so the sketch is one-sided: items are partitioned by
size (powers of two), and an item of n shingles that needs m of them is sketched by its n - m + 1 smallest shingle hashes
(its bottom MinHashes). A document that holds m shingles of the item holds one of these, so no contained item is lost. A
document is looked up partition by partition, with its hashes up to the partition's bound; that part of it is its own
MinHash sketch. Candidates are verified with the words themselves.

The items are taken in blocks of bounded rows and bytes, each against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloam.llm.common import Words, documents, grams, lots, small_batches, spread, utf8
from graphloam.llm.license_scan import WORDS

K, THRESHOLD = 5, Fraction(4, 5)
#: Rows and bytes of a block of items; what is broadcast at once is at most a few times that.
BLOCK_ROWS, BLOCK_BYTES = 50_000, 16 << 20


class ItemIndex:
    """The sketches and shingles of one block of items."""

    def __init__(self, items: list[tuple[object, bytes]], k: int = K, threshold: Fraction = THRESHOLD) -> None:
        self.ids = [i for i, _ in items]
        self.shingles: list[frozenset[bytes]] = []
        self.need: list[int] = []
        sketch: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(items):
            w = Words([text.translate(WORDS)])
            n = len(w.hash)
            size = min(k, n)  # an item of fewer words is one shingle
            if not n:
                self.shingles.append(frozenset())
                self.need.append(1)
                continue
            of = {b" ".join(w.word(i + j) for j in range(size)): int(h) for i, h in enumerate(grams(w.hash, size).tolist())}
            need = math.ceil(threshold * len(of))
            self.shingles.append(frozenset(of))
            self.need.append(need)
            bottom = sorted(of.values())[: len(of) - need + 1]
            sketch.setdefault((size, len(of).bit_length()), []).extend((h, number) for h in bottom)
        #: by shingle size, for each size partition: the bound of the documents' sketch, sorted hashes, and the items of each
        self.sketch: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for (size, _), pairs in sorted(sketch.items()):
            pairs.sort()
            self.sketch.setdefault(size, []).append((pairs[-1][0], np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64)))

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(number of the text, number of the item, shingles that both have) of every contained item."""
        w = Words([t.translate(WORDS) for t in texts])
        for size, parts in self.sketch.items():
            g = grams(w.hash, size)
            inside = w.doc[: len(g)] == w.doc[size - 1 :] if len(g) else np.zeros(0, bool)
            found: set[tuple[int, int]] = set()
            for bound, keys, items in parts:
                at = np.flatnonzero((g <= np.uint64(bound)) & inside)
                low, high = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
                found |= {(int(d), int(items[j])) for d, a, b in zip(w.doc[at][high > low], low[high > low], high[high > low], strict=True) for j in range(a, b)}
            held: tuple[int, set[bytes]] = -1, set()
            for d, item in sorted(found):
                if held[0] != d:
                    words = [w.word(i) for i in range(w.first[d], w.first[d + 1])]
                    held = d, {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}
                shared = len(self.shingles[item] & held[1])
                if shared >= self.need[item]:
                    yield d, item, shared


def _blocks(items: DataFrame, item_text: str, ids: Column, k: int, threshold: Fraction) -> Iterator[Broadcast]:
    """The indexes of blocks of items, of bounded rows and bytes, each broadcast. Rows with one text and id are one item."""
    rows = items.select(ids.alias("i"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("t"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-total["n"] // BLOCK_ROWS), -(-total["b"] // BLOCK_BYTES))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).distinct().collect()
        yield items.sparkSession.sparkContext.broadcast(ItemIndex([(r["i"], bytes(r["t"])) for r in part], k, threshold))


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(key, item_key, n_shared, n_shingles, containment) for every row of docs and every item that it contains.

    Words are lower-cased ASCII letters, digits and non-ASCII characters. Items without words are contained in nothing, null
    texts contain nothing. Very long texts are searched whole, a megabyte or one row at a time. Rows of docs that repeat give
    a result each; rows of items that repeat a key and a text count once, texts under several keys once for each. Ties don't
    matter, other columns are not read. Empty tables give no rows. Each block of BLOCK_ROWS items is one pass over docs.
    """
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    arrow_item = to_arrow_type(items.schema[item_key].dataType)
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, n_shared long, n_shingles long, containment double"
    out = None
    for shared in _blocks(items, item_text, F.col(item_key), k, threshold):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hits = [(begin + d, item, n) for begin, texts in lots(utf8(batch.column(1))) for d, item, n in index.search(texts)]
                sizes = [len(index.shingles[i]) for _, i, _ in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([d for d, _, _ in hits], pa.int64())), pa.array([index.ids[i] for _, i, _ in hits], arrow_item), pa.array([n for *_, n in hits], pa.int64()),
                        pa.array(sizes, pa.int64()), pa.array([n / s for (*_, n), s in zip(hits, sizes, strict=True)], pa.float64()),
                    ], names=[key, item_key, "n_shared", "n_shingles", "containment"],
                )

        found = spread(docs.select(key, text)).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_contained(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item: contained_items() as a filter, row by row, without a
    shuffle and whatever their keys are. Null and empty texts contain nothing and stay; repeated rows stay or go alike; very long
    texts are looked through whole, a megabyte of them or one row at a time. Null, empty and wordless items are in no document, and
    repeated items count once. Ties (several items in a document) make no difference. Empty tables give no rows, or all rows. Other
    columns, of whatever name, pass through."""
    small_batches(docs.sparkSession)
    at, columns = docs.columns.index(text), docs.columns
    for shared in _blocks(items, item_text, F.lit(0), k, threshold):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gone = {begin + d for begin, texts in lots(utf8(batch.column(at))) for d, *_ in shared.value.search(texts)}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in gone], pa.int64())) if gone else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs.select(*columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it contains."""
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
ORACLES = {
    "op5_decontamination": f"""
WITH i AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
ishingle AS (SELECT DISTINCT item_id, least(5, len(ws)) AS k, array_to_string(ws[p:p + least(5, len(ws)) - 1], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM ishingle),
dshingle AS (SELECT DISTINCT doc_id, k, array_to_string(ws[p:p + k - 1], ' ') AS s
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks WHERE len(ws) >= k)),
size AS (SELECT item_id, count(*) AS n FROM ishingle GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS shared FROM ishingle JOIN dshingle USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared::BIGINT AS n_shared, n::BIGINT AS n_shingles, shared::DOUBLE / n AS containment
FROM hit JOIN size USING (item_id) WHERE 5 * shared >= 4 * n"""
}
