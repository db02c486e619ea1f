"""Embeddings and cosine search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.functions import text

DIMENSION, EMBED_BATCH, TOP_K = 768, 10, 10
#: Ids up to this many are broadcast; more are joined.
BROADCAST_IDS = 100_000
#: Query vectors that are broadcast at once; similarities that are computed at once, and rows of which exact ones are; the matrix
#: product may be off by MARGIN.
QUERY_BLOCK, CELLS, EXACT, MARGIN = 4096, 1 << 20, 8192, 1e-9


class EmbeddingError(RuntimeError):
    """A provider gave too few vectors or vectors of another length."""


def hashing_embedder(dimension: int = DIMENSION) -> Callable[[list[str]], list[list[float]]]:
    """An offline provider: signed hashed words, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


def embed_batches(provider: Callable[[list[str]], list[list[float]]], texts: list[str], dimension: int = DIMENSION, batch: int = EMBED_BATCH) -> list[list[float]]:
    """`batch` texts at a time; raises unless each gives as many vectors of the right length."""
    out: list[list[float]] = []
    for i in range(0, len(texts), batch):
        part = texts[i : i + batch]
        got = provider(part)
        if len(got) != len(part):
            raise EmbeddingError(f"{len(part)} texts gave {len(got)} vectors")
        if any(len(v) != dimension for v in got):
            raise EmbeddingError(f"a vector's length is not {dimension}")
        out += got
    return out


def embed_chunks(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], dimension: int = DIMENSION, batch: int = EMBED_BATCH) -> DataFrame:
    """Chunks with their embedding, of name and content."""
    rest = [f for f in chunks.schema.fields if f.name != "embedding"]
    rows = chunks.select(*(f.name for f in rest), text.embed_text(F.col("name"), F.col("content")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", embedding array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = embed_batches(provider, [t or "" for t in b.column(b.num_columns - 1).to_pylist()], dimension, batch)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names[:-1], "embedding"])

    return rows.mapInArrow(run, schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """in double precision; null for vectors of different length, zero vectors and nulls."""
    return F.when(F.size(a) == F.size(b), F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))))


def cosine_topk(chunks: DataFrame, query: list[float], node_ids: DataFrame | None = None, k: int = TOP_K, key: str = "id", vector: str = "embedding", node: str = "nodeId") -> DataFrame:
    """The k rows nearest to the query, with similarity; ties go to the smaller key. node_ids: (id) of the nodes
    to search in. Exact: always min(k, rows with an embedding). The sort keeps k rows a task."""
    rows = chunks.where(F.col(vector).isNotNull())
    if node_ids is not None:
        ids = node_ids.select(F.col("id").alias(node)).distinct()
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        rows = rows.join(F.broadcast(ids) if few else ids, node, "left_semi")
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = float(np.sqrt(np.dot(query, query)))
    near = F.try_divide(_dot(F.col(vector), q), F.sqrt(_dot(F.col(vector), F.col(vector))) * F.lit(norm))
    return rows.where(F.size(vector) == len(query)).withColumn("similarity", near).where("similarity is not null").orderBy(F.desc("similarity"), key).limit(k)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in order, as _dot() does: equal rows have equal sums."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _best(q: np.ndarray, keys: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller key."""
    order = np.lexsort((keys, -sims, q))
    q, keys, sims = q[order], keys[order], sims[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], keys[first], sims[first]


def _nearest(keys: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, key, similarity) of the k nearest rows of each query."""
    norm_r, norm_q = np.sqrt(_dots(rows, rows)), np.sqrt(_dots(queries, queries))
    good = (norm_r > 0) & (norm_r < np.inf)
    keys, rows, norm_r = keys[good], rows[good], norm_r[good]
    asked = np.flatnonzero((norm_q > 0) & (norm_q < np.inf))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    unit_r = rows / norm_r[:, None]
    together = max(1, CELLS // max(1, len(rows)))  # a long batch of rows meets fewer queries at once
    for s in range(0, len(asked) if len(rows) else 0, together):
        part = asked[s : s + together]
        near = (queries[part] / norm_q[part][:, None]) @ unit_r.T
        least = np.partition(near, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(near), -2.0)
        q, r = np.nonzero(near >= least[:, None] - MARGIN)
        q = part[q]
        sims = np.concatenate([_dots(rows[r[i : i + EXACT]], queries[q[i : i + EXACT]]) for i in range(0, len(r), EXACT)]) / (norm_r[r] * norm_q[q])
        out.append(_best(q, keys[r], sims, k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cosine_topk_many(chunks: DataFrame, queries: DataFrame, node_ids: DataFrame | None = None, k: int = TOP_K, key: str = "id", vector: str = "embedding", node: str = "nodeId", block: int = QUERY_BLOCK) -> DataFrame:
    """cosine_topk() for every row (query_id, embedding) of queries: (query_id, key, similarity). Ids and keys are integers.
    Exact: each block of queries meets all rows, a task sends k rows a query. Query ids are unique; queries that are null,
    zero or not finite have no rows, as have rows of another length."""
    spark = chunks.sparkSession
    finite = lambda v: v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = chunks.where(finite(F.col(vector)))
    if node_ids is not None:
        ids = node_ids.select(F.col("id").alias(node)).distinct()
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        rows = rows.join(F.broadcast(ids) if few else ids, node, "left_semi")
    rows = rows.select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("e"))
    asked = queries.where(finite(F.col("embedding"))).select(F.col("query_id").cast("long").alias("q"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        groups: dict[int, tuple[list, list]] = {}
        for r in asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect():
            held = groups.setdefault(len(r["e"]), ([], []))
            held[0].append(r["q"])
            held[1].append(r["e"])
        shared = spark.sparkContext.broadcast({n: (np.array(q, np.int64), np.array(e, np.float64)) for n, (q, e) in groups.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for batch in batches:
                keys, vectors = batch.column(0).to_numpy(), batch.column(1)
                lengths = np.diff(vectors.offsets.to_numpy())
                flat, begin = vectors.values.to_numpy(), vectors.offsets.to_numpy()[:-1]
                for n, (_, asked_for) in shared.value.items():
                    at = np.flatnonzero(lengths == n)
                    if len(at):
                        new = _nearest(keys[at], flat[begin[at][:, None] + np.arange(n)], asked_for, k)
                        held[n] = _best(*(np.concatenate(x) for x in zip(held[n], new, strict=True)), k) if n in held else new
            for n, (q, found, sims) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[n][0][q]), pa.array(found), pa.array(sims)], names=["query_id", "key", "similarity"])

        found = rows.mapInArrow(run, "query_id long, key long, similarity double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "similarity")


def refine(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], question: str, node_ids: DataFrame, k: int = TOP_K) -> DataFrame:
    """The chunks of the given nodes nearest to a question; no ids give no rows without a call of the provider."""
    if not node_ids.limit(1).count():
        return chunks.limit(0).withColumn("similarity", F.lit(None).cast("double"))
    return cosine_topk(chunks, embed([question])[0], node_ids, k)
