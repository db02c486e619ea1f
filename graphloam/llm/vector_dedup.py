"""Embedding near-dedup with hierarchical navigable small-world graphs.

Vectors of one label (and one length) are dealt to shards of bounded size. Each shard's graph of several levels is built once
and stored in the shared folder; every shard's vectors are searched in every graph of their label. A search is a beam search
from the top level down; all queries advance together in numpy. Whoever's beam is full of hits gets a wider one; a beam as
wide as the shard is a scan of it. How wide a beam begins is found by an audit: a bounded number of queries that are known to have
links (copies of stored vectors, moved a little, besides rows of the other shard) are compared with brute force, and all
beams are doubled until the searches find TARGET of those links. Only links that searches found count; an audit that
the widest beam misses stops the job.
Hits are verified by cosine in double precision. A task counts the links of each vector and sends a spanning forest of them;
components of all forests are joined. Equal vectors are searched once and counted with their multiplicity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.llm.common import Durable, join_common, mix, partitions, small_batches
from graphloam.llm.components import components

COSINE = 0.98
#: Vectors of a shard in expectation; neighbours of a node; first width of a beam; nodes of a beam expanded at once.
SHARD, NEIGHBOURS, BEAM, AT_ONCE = 4096, 12, 24, 4
#: Rows of either shard that an audit takes, and the recall that the searches must reach.
AUDIT, TARGET = 64, 0.999
#: Queries that advance together; float32 similarities may be off by MARGIN.
TOGETHER, MARGIN = 512, 1e-4


class Graph:
    """levels[l]: neighbours (n x width, -1 for none) among the nodes of level l; a node of level l is in all below."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, neighbours: int = NEIGHBOURS) -> None:
        self.x, n = vectors, len(vectors)
        draw = (mix(ids.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        height = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(neighbours)).astype(int)
        top = int(height.max(initial=0))
        height[np.argmax(height)] = top
        self.entry = int(np.argmax(height))
        self.levels: list[np.ndarray] = []
        for level in range(top, -1, -1):
            self.levels.insert(0, np.full((n, 2 * neighbours), -1, np.int64))
            nodes = np.flatnonzero(height >= level)
            nodes = nodes[np.argsort(nodes != self.entry, kind="stable")]
            done = 1
            while done < len(nodes):  # in batches that double the graph at most
                new = nodes[done : done + max(done, 32)]
                self._insert(nodes[:done], new, neighbours)
                done += len(new)

    def dump(self) -> bytes:
        """What load() makes the graph of again, its vectors left out."""
        levels = [(np.flatnonzero((adj >= 0).any(1)).astype(np.int32), adj) for adj in self.levels]
        return pickle.dumps((self.entry, [(rows, adj[rows].astype(np.int32)) for rows, adj in levels]))

    @staticmethod
    def load(vectors: np.ndarray, dumped: bytes) -> Graph:
        g = Graph.__new__(Graph)
        g.x, g.levels = vectors, []
        g.entry, levels = pickle.loads(dumped)
        for rows, held in levels:
            adj = np.full((len(vectors), held.shape[1]), -1, np.int64)
            adj[rows] = held
            g.levels.append(adj)
        return g

    def _insert(self, old: np.ndarray, new: np.ndarray, neighbours: int) -> None:
        adj = self.levels[0]
        for s in range(0, len(new), TOGETHER):
            part = new[s : s + TOGETHER]
            if len(old) <= 64:
                near = old[np.argsort(-(self.x[part] @ self.x[old].T), axis=1, kind="stable")[:, :neighbours]]
            else:
                start = self._descend(self.x[part], stop=0)
                near = self.beam(self.x[part], start, 2 * neighbours, 0)[0][:, :neighbours]
            among = self.x[part] @ self.x[part].T  # the batch's nodes know each other
            np.fill_diagonal(among, -2)
            own = part[np.argsort(-among, axis=1, kind="stable")[:, : neighbours // 2]]
            near = np.concatenate([near, np.where(np.arange(own.shape[1])[None, :] < len(part) - 1, own, -1)], axis=1)
            self._connect(adj, part, near)

    def _connect(self, adj: np.ndarray, part: np.ndarray, near: np.ndarray) -> None:
        a, b = np.repeat(part, near.shape[1]), near.ravel()
        ok = (b >= 0) & (a != b)
        a, b = a[ok], b[ok]
        touched = np.unique(np.concatenate([a, b]))
        held_a, held_b = np.repeat(touched, adj.shape[1]), adj[touched].ravel()
        u, v = np.concatenate([a, b, held_a[held_b >= 0]]), np.concatenate([b, a, held_b[held_b >= 0]])
        pair = np.unique(u * len(adj) + v)
        u, v = pair // len(adj), pair % len(adj)
        sims = np.concatenate([np.einsum("ij,ij->i", self.x[u[s : s + 65536]], self.x[v[s : s + 65536]]) for s in range(0, len(u), 65536)])
        # the nearest three quarters of a full row stay, and of the rest the farthest: they keep clusters connected
        order = np.lexsort((-sims, u))
        u, v = u[order], v[order]
        begin = np.searchsorted(u, touched)
        count = np.searchsorted(u, touched, "right") - begin
        rank, width = np.arange(len(u)) - np.repeat(begin, count), adj.shape[1]
        far = width // 4
        keep = (rank < width - far) | (rank >= np.repeat(count, count) - far)
        u, v = u[keep], v[keep]
        begin = np.searchsorted(u, touched)
        adj[touched] = -1
        adj[u, np.arange(len(u)) - np.repeat(begin, np.searchsorted(u, touched, "right") - begin)] = v

    def _descend(self, queries: np.ndarray, stop: int) -> np.ndarray:
        """Entry points of level `stop`."""
        at = np.full((len(queries), 1), self.entry)
        for level in range(len(self.levels) - 1, stop, -1):
            at = self.beam(queries, at, 4, level)[0][:, :2]
        return at

    def beam(self, queries: np.ndarray, start: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes found for each query, best first (-1 and -2 where fewer were found)."""
        q, adj = len(queries), self.levels[level]
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, len(self.x) + 1), bool)  # the last column is for "no node"
        seen[:, -1] = True
        ids = np.full((q, width + start.shape[1]), -1)
        sims = np.full(ids.shape, -2.0, np.float32)
        open_ = np.zeros(ids.shape, bool)
        for c in range(start.shape[1]):
            fresh = ~seen[np.arange(q), start[:, c]]
            ids[fresh, c] = start[fresh, c]
            sims[fresh, c] = np.einsum("ij,ij->i", queries[fresh], self.x[start[fresh, c]])
            seen[np.arange(q), start[:, c]] = True
        open_ = ids >= 0
        live = np.arange(q)
        while len(live):
            order = np.argsort(-sims[live], axis=1, kind="stable")[:, :width]
            r = live[:, None]
            ids[live, :width], sims[live, :width], open_[live, :width] = ids[r, order], sims[r, order], open_[r, order]
            ids[live, width:], sims[live, width:], open_[live, width:] = -1, -2, False
            live = live[open_[live].any(1)]
            if not len(live):
                break
            pick = np.argsort(~open_[live], axis=1, kind="stable")[:, :AT_ONCE]
            r = live[:, None]
            chosen = np.where(open_[r, pick], ids[r, pick], -1)
            open_[r, pick] = False
            next_ = np.where(chosen[:, :, None] >= 0, adj[chosen], -1).reshape(len(live), -1)
            next_.sort(axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            next_[seen[r, next_]] = -1
            seen[r, next_] = True
            seen[:, -1] = True
            a, b = np.nonzero(next_ >= 0)
            found = np.full(next_.shape, -2, np.float32)
            for s in range(0, len(a), 1 << 17):
                x, y = a[s : s + (1 << 17)], b[s : s + (1 << 17)]
                found[x, y] = np.einsum("ij,ij->i", queries[live[x]], self.x[next_[x, y]])
            best = np.argsort(-found, axis=1, kind="stable")[:, :width]
            room = width + best.shape[1]
            if ids.shape[1] < room:
                pad = room - ids.shape[1]
                ids, sims, open_ = (np.pad(m, ((0, 0), (0, pad)), constant_values=v) for m, v in ((ids, -1), (sims, -2), (open_, False)))
            at = np.arange(len(live))[:, None]
            ids[r, width + np.arange(best.shape[1])] = next_[at, best]
            sims[r, width + np.arange(best.shape[1])] = found[at, best]
            open_[r, width + np.arange(best.shape[1])] = next_[at, best] >= 0
        del rows
        return ids[:, :width], sims[:, :width]

    def hits(self, queries: np.ndarray, least: float, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(number of the query, node) of what the searches find at a similarity of `least`."""
        out = []
        for s in range(0, len(queries), TOGETHER):
            todo, w = np.arange(s, min(s + TOGETHER, len(queries))), width
            while len(todo):
                if 4 * w >= len(self.x):  # a beam of the whole shard
                    r, c = np.nonzero(queries[todo] @ self.x.T >= least)
                    out.append((todo[r], c))
                    break
                ids, sims = self.beam(queries[todo], self._descend(queries[todo], 0), w, 0)
                full = (sims >= least).all(1)
                r, c = np.nonzero((sims >= least) & ~full[:, None])
                out.append((todo[r], ids[r, c]))
                todo, w = todo[full], 4 * w
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; none is zero."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y) that link, by brute force; x is small."""
    a, b = np.nonzero(x @ y.T >= cosine - MARGIN)
    ok = np.concatenate([np.einsum("ij,ij->i", x[a[s : s + (1 << 16)]], y[b[s : s + (1 << 16)]]) >= cosine for s in range(0, len(a), 1 << 16)] or [np.zeros(0, bool)])
    return a[ok], b[ok]


def probes(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Queries of an audit of a graph of y: AUDIT evenly spaced rows of x, and copies of AUDIT rows of y, moved to a cosine
    between `cosine` and 1. So there are true links, whatever x holds."""
    own = y[np.unique(np.linspace(0, len(y) - 1, AUDIT).astype(int))]
    if own.shape[1] > 1:
        rng = np.random.default_rng(len(y))
        aside = rng.normal(size=own.shape)
        aside -= np.einsum("ij,ij->i", aside, own)[:, None] * own
        to = cosine + (1 - cosine) * rng.uniform(0.1, 0.9, len(own))[:, None]
        own = unit(to * own + np.sqrt(1 - to * to) * unit(aside))
    return np.concatenate([x[np.unique(np.linspace(0, len(x) - 1, AUDIT).astype(int))], own])


def audited_width(graph: Graph, x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[int, int, int]:
    """The narrowest beam with which searches in the graph of y find TARGET of an audit's true links; how many those are, and
    how many of them were found. Raises if a beam of the whole shard does not."""
    queries = probes(x, y, cosine)
    u, v = linked(queries, y, cosine)
    width = BEAM
    while True:
        hit = np.zeros((len(queries), len(y)), bool)
        for q, node in graph.hits(queries.astype(np.float32), cosine - MARGIN, width):
            hit[q, node] = True
        found = int(hit[u, v].sum())
        if found >= TARGET * len(u):
            return width, len(u), found
        if width >= len(y):
            raise RuntimeError(f"searches of a graph of {len(y)} vectors found {found} of {len(u)} links with the widest beam")
        width *= 2


def found_links(x: np.ndarray, graph: Graph, y: np.ndarray | None, other: Graph | None, cosine: float = COSINE) -> tuple[np.ndarray, int, int]:
    """Which rows of x link with which rows of y, or with other rows of x if y is None, as the searches of both graphs find them;
    and how many true links the audits had, and how many of them were found. Rows are of length 1, in double precision."""
    own = y is None
    y = x if own else y
    ways = [(graph, x, x, False)] if own else [(other, x, y, False), (graph, y, x, True)]
    out, seen, right = np.zeros((len(x), len(y)), bool), 0, 0
    for g, queries, stored, turned in ways:
        width, true, found = audited_width(g, queries, stored, cosine)
        seen, right = seen + true, right + found
        for q, node in g.hits(queries.astype(np.float32), cosine - MARGIN, width):
            i, j = (node, q) if turned else (q, node)
            for s in range(0, len(i), 1 << 16):
                r, c = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                ok = np.einsum("ij,ij->i", x[r], y[c]) >= cosine
                out[r[ok], c[ok]] = True
    if own:
        out |= out.T
        np.fill_diagonal(out, False)
    return out, seen, right


def all_links(x: np.ndarray, y: np.ndarray | None, cosine: float = COSINE) -> np.ndarray:
    """The same by comparing all rows."""
    own = y is None
    y = x if own else y
    out = np.zeros((len(x), len(y)), bool)
    for s in range(0, len(x), TOGETHER):
        a, b = linked(x[s : s + TOGETHER], y, cosine)
        out[s + a, b] = True
    if own:
        np.fill_diagonal(out, False)
    return out


def forest(links: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """Edges (row, column) that join what the links join; of a square matrix both are rows."""
    n, m = links.shape
    if square:
        out, left = [], links.any(1)
        while left.any():
            root = int(np.argmax(left))
            left[root] = False
            front = np.array([root])
            while len(front):
                front = np.flatnonzero(links[front].any(0) & left)
                left[front] = False
                out += [(root, int(i)) for i in front]
        return out
    out, rows = [], links.any(1)
    columns = links.any(0)
    while rows.any():
        root = int(np.argmax(rows))
        rows[root] = False
        front = np.array([root])
        first = None
        while len(front):
            cols = np.flatnonzero(links[front].any(0) & columns)
            columns[cols] = False
            out += [(root, int(c)) for c in cols]
            first = int(cols[0]) if first is None and len(cols) else first
            front = np.flatnonzero(links[:, cols].any(1) & rows) if len(cols) else cols
            rows[front] = False
            out += [(int(r), first) for r in front]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """A sorted partition's runs of rows with the same first `keys` columns."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(x).to_numpy() for x in range(keys)]
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            change |= np.diff(c) != 0
        cut = (np.flatnonzero(change) + 1).tolist()
        for s, e in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            if s == e:
                continue
            key = tuple(int(c[s]) for c in columns)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(batch.slice(s, e - s))
    if held:
        yield now, held


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, shard: int = SHARD, keep: Durable | None = None, report: dict | None = None, exact: bool = False) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    key: an integer column. Rows link only when their labels are equal and not null and their vectors have one length; null
    and empty vectors, zero vectors and those with null or non-finite components link with nothing. Rows that repeat a key
    are vectors of their own, but are one node for the components. Rows with a null key have no component and aren't kept.
    Equal vectors of a label (ties) link. An empty table gives no rows; other columns, of whatever name, are not read. report: takes
    what the audits saw: `true` links of the audited queries, of which `found` by the searches, and their ratio `recall` (None
    without an audit). exact: all vectors of a label are compared, in the place of the searches and their audits.
    """
    spark, keep = vectors.sparkSession, keep or Durable(vectors.sparkSession)
    small_batches(spark)
    parts = partitions(spark)
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.transform(F.col(embedding), lambda x: x.cast("double") + F.lit(0.0)).alias("e"), F.col(label).alias("l"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(F.col("k").isNotNull() & F.col("l").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    # a vector of a label is told by two hashes, 128 bits
    whole = keep.keep(rows.withColumns({"good": good, "f": F.xxhash64("l", "e"), "f2": F.xxhash64(F.lit(1), "l", "e")}))
    classes = keep.keep(whole.where("good").groupBy("l", "f", "f2").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("e").alias("e")).withColumn("d", F.size("e")))
    sizes = classes.groupBy("l", "d").agg(F.count(F.lit(1)).alias("n"))
    placed = join_common(classes, sizes, ["l", "d"], "n", classes.count())
    shards = F.ceil(F.col("n") / shard).cast("int")
    placed = placed.select(F.xxhash64("l", "d").alias("g"), "d", F.pmod("f", shards).cast("int").alias("s"), shards.alias("shards"), "f", "f2", "rep", "m", "e")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, d, s), held in _runs(batches, 3):
            f, f2, rep, m = (np.concatenate([b.column(x).to_numpy() for b in held]) for x in (4, 5, 6, 7))
            x = unit(np.concatenate([b.column(8).flatten().to_numpy().reshape(b.num_rows, d) for b in held]))
            order = np.lexsort((f2, f))
            f, f2, rep, m, x = f[order], f2[order], rep[order], m[order], x[order]
            blob = pickle.dumps((f, f2, rep, m, x, Graph(x.astype(np.float32), f).dump()))
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([d], pa.int32()), pa.array([s], pa.int32()), pa.array([held[0].column(3)[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], names=["g", "d", "s", "shards", "graph"])

    graphs = keep.keep(placed.repartition(parts, "g", "d", "s").sortWithinPartitions("g", "d", "s").mapInArrow(build, "g long, d int, s int, shards int, graph binary"))
    pairs = graphs.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("g", "d", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "s", "graph")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(blob: bytes) -> tuple:
            *numbers, x, graph = pickle.loads(blob)
            return *numbers, x, Graph.load(x.astype(np.float32), graph)

        for (_, _, i, j), held in _runs(batches, 4):
            blobs = {s: blob for b in held for s, blob in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)}
            if len(blobs) < 1 + (i != j):  # an empty shard has no graph
                continue
            f, f2, rep, m, x, graph = opened(blobs[i])
            if i == j:
                g, g2, other_rep, other_m = f, f2, rep, m
                found, seen, right = (all_links(x, None, cosine), 0, 0) if exact else found_links(x, graph, None, None, cosine)
            else:
                g, g2, other_rep, other_m, y, other = opened(blobs[j])
                found, seen, right = (all_links(x, y, cosine), 0, 0) if exact else found_links(x, graph, y, other, cosine)
            count = np.concatenate([found[r : r + 512] @ other_m for r in range(0, len(f), 512)])
            edges = np.array([(rep[a], other_rep[b]) for a, b in forest(found, i == j)], np.int64).reshape(-1, 2)
            kind = [np.zeros(len(f)), np.ones(len(edges)), [2]]
            u, v, n = [f, edges[:, 0], [seen]], [f2, edges[:, 1], [right]], [count, np.zeros(len(edges)), [0]]
            if i != j:
                kind.append(np.zeros(len(g)))
                u.append(g)
                v.append(g2)
                n.append(np.concatenate([m @ found[:, c : c + 512] for c in range(0, len(g), 512)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kind).astype(np.int32)), *(pa.array(np.concatenate(c).astype(np.int64)) for c in (u, v, n))], names=["kind", "u", "v", "n"])

    found = keep.keep(pairs.repartition(parts, "g", "d", "i", "j").sortWithinPartitions("g", "d", "i", "j").mapInArrow(search, "kind int, u long, v long, n long"))
    keep.drop(graphs)
    if report is not None:
        seen = found.where("kind = 2").agg(F.sum("u").alias("true"), F.sum("v").alias("found")).first()
        report |= {"true": seen["true"] or 0, "found": seen["found"] or 0, "recall": seen["found"] / seen["true"] if seen["true"] else None}
    counts = found.where("kind = 0").groupBy(F.col("u").alias("f"), F.col("v").alias("f2")).agg(F.sum("n").alias("n"))
    joined = components(found.where("kind = 1").select("u", "v"), keep)
    of_class = classes.select("f", "f2", "rep", "m").join(counts, ["f", "f2"], "left").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = keep.keep(of_class.select("f", "f2", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = join_common(whole.where("good").select("k", "f", "f2"), of_class, ["f", "f2"], "m", whole.count()).select("k", "n_links", "component_id")
    alone = whole.where("not good").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    return linked.unionByName(alone).select(F.col("k").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("k") == F.col("component_id"), F.lit(False)).alias("kept"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among the embeddings of one label."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES = {
    "op9_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b USING (label) WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.m AS component_id, vec_id = c.m AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
}
