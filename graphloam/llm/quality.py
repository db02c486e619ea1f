"""A quality classifier by hierarchical empirical Bayes.

Two heads - low quality and toxic - each give every document a posterior: the evidence of its text from a classifier,
combined with what its path and host tell. Labels, and the classifier's posteriors where there are none, are summed by path
and host (grouped aggregation); a host's rate is shrunk toward the global rate, a path's toward its host's, by beta priors
whose strengths are estimated from the spread of the rates. Sparse sites so stay near the global prior. A document's own
share is taken out of its site before it is used.

The text classifier: shares of character classes, word repetition and the like, and two lexicons - of hashed words and of
four bytes within words, so that stems count under any ending - with their log odds, in a logistic regression. It is fitted on
a bounded sample: of FIT_ROWS labelled keys, those with the smallest hashes, one row each; odd hashes fit the lexicon, even
ones the regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.llm.common import LOWER, PASS_BYTES, SPACES, Durable, Words, documents, join_common, lots, mix, small_batches, utf8

FIT_ROWS = 24_000
#: Buckets of a lexicon; documents with a label that a bucket needs before it counts as evidence.
BUCKETS, SUPPORT = 1 << 18, 6
REJECT = 0.5
#: Documents that a prior counts for at least.
LEAST_STRENGTH = 20.0
HEADS = ("low", "toxic")

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"-()?", "!", "|", "%&$#*@^~<>=+{}[]\\/_`", " \t\r", "\n"]
_CLASS = np.full(256, len(_CLASSES), np.int8)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k


@dataclass
class Features:
    """Of several texts: a row of numbers each; distinct (text, bucket of a word) pairs; buckets of four-byte grams, those of
    text i at begin[i]:begin[i + 1]."""

    dense: np.ndarray
    of: np.ndarray
    bucket: np.ndarray
    grams: np.ndarray
    begin: np.ndarray

    def presence(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (text, bucket) pairs of words, and of grams in the buckets behind those of words."""
        key = np.unique(np.repeat(np.arange(len(self.dense)), np.diff(self.begin)) * BUCKETS + self.grams)
        return np.concatenate([self.of, key // BUCKETS]), np.concatenate([self.bucket, key % BUCKETS + BUCKETS])


def byte_grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all four bytes within a word, and where each begins; some PASS_BYTES at a time."""
    gap, buckets, places = SPACES[raw], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for begin in range(0, max(0, len(raw) - 3), PASS_BYTES):
        n = min(PASS_BYTES, len(raw) - 3 - begin)
        apart, four = np.zeros(n, bool), np.zeros(n, np.uint64)
        for j in range(4):
            apart |= gap[begin + j : begin + j + n]
            four |= raw[begin + j : begin + j + n].astype(np.uint64) << np.uint64(8 * j)
        at = np.flatnonzero(~apart)
        buckets.append((mix(four[at]) & np.uint64(BUCKETS - 1)).astype(np.int32))
        places.append(at + begin)
    return np.concatenate(buckets), np.concatenate(places)


def text_features(texts: list[bytes]) -> Features:
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    raw, kinds = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), len(_CLASSES) + 1
    counts = np.zeros(n * kinds, np.int64)
    for s in range(0, len(raw), PASS_BYTES):
        part = raw[s : s + PASS_BYTES]
        first, last = np.searchsorted(begin, [s, s + len(part) - 1], "right") - 1
        own = np.repeat(np.arange(first, last + 1), np.diff(np.clip(begin[first : last + 2], s, s + len(part))))
        counts += np.bincount(own * kinds + _CLASS[part], minlength=n * kinds)
    counts = counts.reshape(n, kinds)
    counts[:, _CLASS[10]] -= 1  # the end of line behind each text
    shares = counts / np.maximum(1, sizes)[:, None]
    w = Words([t.translate(LOWER) for t in texts])
    words = np.diff(w.first)
    pairs, times = np.unique(w.doc.astype(np.uint64) << np.uint64(32) | w.hash >> np.uint64(32), return_counts=True)
    of = (pairs >> np.uint64(32)).astype(np.int64)
    distinct, top = np.bincount(of, minlength=n), np.zeros(n)
    np.maximum.at(top, of, times)
    longest = np.bincount(w.doc, w.end - w.start, minlength=n) / np.maximum(1, words)
    dense = np.column_stack([shares, np.log1p(words), np.log1p(longest), distinct / np.maximum(1, words), top / np.maximum(1, words)])
    key = np.unique(of * BUCKETS + (pairs & np.uint64(BUCKETS - 1)).astype(np.int64))
    grams, at = byte_grams(np.frombuffer(w.data, np.uint8))
    return Features(dense, key // BUCKETS, key % BUCKETS, grams, np.searchsorted(at, begin))


def _per_text(how: np.ufunc, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """how.reduce over each text's values, 0 for none."""
    out, full = np.zeros(len(begin) - 1), np.flatnonzero(np.diff(begin))
    if len(full):
        out[full] = how.reduceat(values, begin[full])
    return out


@dataclass
class Head:
    """A logistic regression over the dense features, their squares, and the lexicons' largest, smallest and mean log odds."""

    lexicon: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def design(f: Features, lexicon: np.ndarray) -> np.ndarray:
        columns = [f.dense, f.dense**2]
        ordered = np.searchsorted(f.of, np.arange(len(f.dense) + 1))
        for odds, begin in ((lexicon[f.bucket], ordered), (lexicon[BUCKETS + f.grams], f.begin)):
            columns += [_per_text(np.maximum, odds, begin), _per_text(np.minimum, odds, begin), _per_text(np.add, odds, begin) / np.maximum(1, np.diff(begin))]
        return np.column_stack(columns)

    def logit(self, f: Features) -> np.ndarray:
        x = (self.design(f, self.lexicon) - self.mean) / self.scale
        return np.clip(self.weights[0] + np.clip(x, -12, 12) @ self.weights[1:], -30, 30)


def fit_lexicon(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int, support: int = SUPPORT) -> np.ndarray:
    """Log odds of a bucket's presence, 0 where too few documents tell."""
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    return np.where((bad >= support) | (good >= support * max(1.0, n_good / max(1, n_bad))), odds, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps with a ridge, each halved until it lowers the loss; the intercept comes first and is hardly shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1])
    w[0] = np.log(rate / (1 - rate))
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + (penalty * v * v).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-4 and (new := loss(w + size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - new < 1e-8 * (1 + abs(now)):
            break
        w, now = w + size * step, new
    return w


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, fit_rows: int) -> DataFrame:
    """(text, low, toxic, odd) of the labelled keys with the smallest hashes, at most fit_rows rows: of the rows of one key the
    smallest text."""
    chosen = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    chosen = chosen.withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(fit_rows)
    # at most fit_rows small rows are broadcast
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "k")
    one = rows.groupBy("k", "h", "quality", "toxic").agg(F.min("t").alias("t"))
    return one.select("t", (F.col("quality") == 0).cast("int").alias("low"), F.col("toxic").cast("int").alias("toxic"), (F.pmod("h", F.lit(2))).cast("int").alias("odd"))


def fit(docs: DataFrame, labels: DataFrame, keep: Durable, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> list[Head] | None:
    """The two heads; None if no labelled row of both kinds is there."""
    small_batches(docs.sparkSession)
    sample = keep.keep(_sample(docs, labels, key, text, fit_rows).repartition(8))

    def lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 2 * BUCKETS + 1), np.int64)  # the last column counts documents
        for batch in batches:
            low, toxic, odd = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for begin, part in lots(utf8(batch.column(0))):
                of, bucket = text_features(part).presence()
                label = (low * 2 + toxic)[begin : begin + len(part)]
                use = odd[begin : begin + len(part)] == 1
                for k in range(4):
                    held[k, -1] += int((use & (label == k)).sum())
                    held[k] += np.bincount(bucket[(use & (label == k))[of]], minlength=2 * BUCKETS + 1)
        b = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), *(pa.array(held[k][b]) for k in range(4))], names=["b", "n0", "n1", "n2", "n3"])

    sums = sample.select("t", "low", "toxic", "odd").mapInArrow(lexicon, "b int, n0 long, n1 long, n2 long, n3 long").groupBy("b").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))
    counts = sums.where((F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3") >= SUPPORT) | (F.col("b") == 2 * BUCKETS)).toPandas()  # 2 * BUCKETS + 1 rows at most
    table = np.zeros((4, 2 * BUCKETS + 1), np.int64)
    table[:, counts.b.to_numpy(int)] = counts[["n0", "n1", "n2", "n3"]].to_numpy().T
    bad = {"low": table[2] + table[3], "toxic": table[1] + table[3]}
    lexicons = [fit_lexicon(bad[h][:-1], table.sum(0)[:-1] - bad[h][:-1], bad[h][-1], table.sum(0)[-1] - bad[h][-1]) for h in HEADS]
    width = Head.design(text_features([b"a"]), lexicons[0]).shape[1]

    def designs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in lots(utf8(batch.column(0))):
                f = text_features(part)
                x = np.column_stack([Head.design(f, lex) for lex in lexicons])
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), *(batch.column(i)[begin : begin + len(part)] for i in (1, 2))], names=["x", "low", "toxic"])

    rows = sample.where("odd = 0").select("t", "low", "toxic").mapInArrow(designs, "x array<double>, low int, toxic int").toPandas()  # half of fit_rows, some 60 numbers each
    keep.drop(sample)
    if not len(rows):
        return None
    x, out = np.array(rows.x.tolist()), []
    for i, h in enumerate(HEADS):
        own, y = x[:, i * width : (i + 1) * width], rows[h].to_numpy(float)
        mean, scale = own.mean(0), np.maximum(own.std(0), 1e-6)
        out.append(Head(lexicons[i], mean, scale, fit_logistic(np.clip((own - mean) / scale, -12, 12), y)))
    return out


def site_columns(source: Column) -> tuple[Column, Column]:
    """(host, path) of a source: of a URL, without its query, the host and its first path segment; of another name both are
    the name."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")
    return F.element_at(F.split(bare, "/"), 1), F.array_join(F.slice(F.split(bare, "/"), 1, 2), "/")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(rate: Column, n: Column, prior: Column) -> Column:
    """Method of moments: the beta strength that explains the spread of the rates around the prior beyond binomial noise."""
    noise = F.sum(prior * (1 - prior) / n * n) / F.sum(n)
    spread = F.sum(n * (rate - prior) * (rate - prior)) / F.sum(n) - noise
    unit = F.sum(n * prior * (1 - prior)) / F.sum(n)
    return F.coalesce(F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(1e4), F.try_divide(unit, F.greatest(spread, F.lit(1e-6))))), F.lit(100.0))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: Column | None = None, fit_rows: int = FIT_ROWS, reject: float = REJECT, keep: Durable | None = None, label_key: str | None = None) -> DataFrame:
    """(key, p_low, p_toxic, keep) for every row.

    keep: both posteriors are at most `reject`. Null texts count as empty, null sources as one site. Without labelled rows
    of a kind nothing tells, and every document is kept. Repeated keys are scored row by row, and count for their site each; a
    label holds for all rows of its key, and of several labels of one key the worst; rows without a key have none. Ties (a posterior of just `reject`) are kept. label_key:
    the column that tells which label is whose, in docs and labels, if it is not the key. Very long texts are read whole. Other columns, of
    whatever name, are not read. An empty table gives no rows.
    """
    spark, keep = docs.sparkSession, keep or Durable(docs.sparkSession)
    small_batches(spark)
    label_key = label_key or key
    labels = labels.select(F.col(label_key).alias("k"), "quality", "toxic")
    heads = fit(docs.select(F.col(label_key).alias("k"), F.col(text).alias("t")), labels, keep, "k", "t", fit_rows)
    kinds = dict(docs.dtypes)
    if heads is None:
        return docs.select(key, F.lit(0.0).alias("p_low"), F.lit(0.0).alias("p_toxic"), F.lit(True).alias("keep"))
    shared = spark.sparkContext.broadcast(heads)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2))]
            for _, part in lots(utf8(batch.column(4))):
                f = text_features(part)
                found.append(np.column_stack([h.logit(f) for h in shared.value]))
            logits = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(logits[:, 0]), pa.array(logits[:, 1])], names=["k", "label_k", "host", "path", "e_low", "e_toxic"])

    host, own_path = site_columns(F.col(source))
    rows = docs.select(F.col(key).alias("k"), F.col(label_key).alias("label_k"), host.alias("host"), (own_path if path is None else F.concat_ws("/", host, path)).alias("path"), F.col(text).alias("t"))
    told = keep.keep(rows.mapInArrow(evidence, f"k {kinds[key]}, label_k {kinds[label_key]}, host string, path string, e_low double, e_toxic double"))
    known = labels.where("k is not null").groupBy(F.col("k").alias("label_k")).agg((1 - F.min("quality")).cast("double").alias("y_low"), F.max("toxic").cast("double").alias("y_toxic"))
    # rows without a key don't go into the join, where they would meet in one task
    soft = told.where("label_k is not null").join(known, "label_k", "left").unionByName(told.where("label_k is null"), allowMissingColumns=True)
    for h in HEADS:
        soft = soft.withColumn(f"s_{h}", F.coalesce(f"y_{h}", 1 / (1 + F.exp(-F.col(f"e_{h}")))))
    paths = keep.keep(soft.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_path"), *(F.sum(f"s_{h}").alias(f"path_{h}") for h in HEADS)))
    hosts = keep.keep(paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), *(F.sum(f"path_{h}").alias(f"host_{h}") for h in HEADS)))
    world = hosts.agg(F.sum("n_host").alias("n"), *(F.sum(f"host_{h}").alias(h) for h in HEADS)).first()
    if not world["n"]:
        return docs.select(key, F.lit(0.0).alias("p_low"), F.lit(0.0).alias("p_toxic"), F.lit(True).alias("keep"))
    base = {h: min(1 - 1e-6, max(1e-6, world[h] / world["n"])) for h in HEADS}
    of_hosts = hosts.agg(*(_strength(F.col(f"host_{h}") / F.col("n_host"), F.col("n_host"), F.lit(base[h])).alias(h) for h in HEADS)).first()
    sites = paths.join(hosts, "host")
    of_paths = sites.agg(*(_strength(F.col(f"path_{h}") / F.col("n_path"), F.col("n_path"), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(f"host_{h}") / F.col("n_host")))).alias(h) for h in HEADS)).first()
    out = join_common(soft, sites, ["host", "path"], "n_path", world["n"])
    for h in HEADS:
        # without the document's own share
        at_host = (F.col(f"host_{h}") - F.col(f"s_{h}") + of_hosts[h] * base[h]) / (F.col("n_host") - 1 + of_hosts[h])
        at_path = (F.col(f"path_{h}") - F.col(f"s_{h}") + of_paths[h] * at_host) / (F.col("n_path") - 1 + of_paths[h])
        site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), at_path))
        prior = float(np.log(base[h] / (1 - base[h])))
        out = out.withColumn(f"p_{h}", 1 / (1 + F.exp(-(F.col(f"e_{h}") + _logit(site) - F.lit(prior)))))
    return out.select(F.col("k").alias(key), "p_low", "p_toxic", ((F.col("p_low") <= reject) & (F.col("p_toxic") <= reject)).alias("keep"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and decision for every document; documents have no path, so host and language stand for one."""
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), path=F.col("lang"))
