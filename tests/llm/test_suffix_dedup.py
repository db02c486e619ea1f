"""Suffix-array dedup against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from graphloam.llm import suffix_dedup


def brute(texts: list[str | None], window: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    starts = Counter(r[p : p + window] for r in raw for p in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - window + 1):
            if starts[r[p : p + window]] > 1:
                gone[p : p + window] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone)).view(np.int8))).tolist()
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        out.append((len(r), int(gone.sum()), [tuple(edges[i : i + 2]) for i in range(0, len(edges), 2)], kept))
    return out


def held(rows) -> list[tuple]:
    return [(r["__n_bytes"], r["__n_removed"], [(s.first, s.end) for s in r["__spans"]], bytes(r["__kept"])) for r in rows]


def corpus(seed: int, n: int, size: int) -> list[str | None]:
    """Texts of few letters, with copies, near copies, shared passages, runs of one letter, and periods."""
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choices("abcdé 東", k=k))
    passage, out = letters(2 * size), [None, "", "a" * (size - 1), "a" * size, "b" * (4 * size), "xyz" * size, "é" * size]
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0 and len(out) > 8:
            out.append(rng.choice(out[7:]))
        elif kind == 1 and len(out) > 8:
            t = rng.choice(out[7:])
            i = rng.randrange(len(t) + 1)
            out.append(t[:i] + letters(1) + t[i + rng.randrange(2) :])
        elif kind == 2:
            out.append(letters(rng.randrange(size)) + passage[rng.randrange(size) :] + letters(rng.randrange(size)))
        else:
            out.append(letters(rng.randrange(1, 5 * size)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("window", "span", "hot"), [(24, None, None), (24, 7, 2), (40, 16, 3), (13, 5, 1), (8, None, 2), (80, 30, 2)])
def test_removed_bytes_against_brute_force(spark, window, span, hot):
    texts = corpus(window, 80, window)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, blob string, k int, row int").repartition(3)
    got = suffix_dedup.dedup_bytes(docs, window=window, span=span, hot=hot).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.blob, r.k, r.row) for r in got] == [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    assert held(got) == brute(texts, window)


def test_a_passage_in_every_document(spark):
    """The edge of a common passage: windows that differ in each document, but share an anchor."""
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh", k=100))
    texts = ["".join(rng.choices("abcdefgh", k=rng.randrange(80))) + passage + "".join(rng.choices("abcdefgh", k=rng.randrange(80))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for hot in (None, 5):
        assert held(suffix_dedup.dedup_bytes(docs, window=48, hot=hot).orderBy("doc_id").collect()) == brute(texts, 48)


def test_windows_of_production_size(spark):
    documents = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").sort_values("doc_id")
    got = {r.doc_id: r for r in suffix_dedup.op13_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    want = brute([t if isinstance(t, str) else None for t in documents["text"]], 400)
    assert len(got) == len(documents)
    for key, (n, removed, spans, kept) in zip(documents["doc_id"], want, strict=True):
        r = got[key]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, len(spans), hashlib.sha256(kept).hexdigest())


def test_repeated_and_null_keys_long_texts_and_no_rows(spark):
    long = " ".join(str(i * 7919 % 104729) for i in range(40_000))
    rows = [(1, "k" * 500), (1, "k" * 500), (None, long), (None, "m" * 10 + long[1000:2000]), (2, long[:300]), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "`my key` long, body string")
    out = suffix_dedup.dedup_bytes(docs, key="my key", text="body")
    want = brute([t for _, t in rows], 400)
    assert sorted(map(repr, held(out.collect()))) == sorted(map(repr, want))
    assert suffix_dedup.dedup_bytes(docs.limit(0), key="my key", text="body").count() == 0
    assert suffix_dedup.dedup_bytes(docs.where("body is null"), key="my key", text="body").count() == 2


def test_shards_merge_to_the_order_of_all_suffixes():
    rng = random.Random(9)
    parts = [bytes(rng.choices(b"ab", k=rng.randrange(20, 120))) for _ in range(30)]
    for window in (8, 16, 20):
        for n in (1, 3, 7):
            shards = [parts[i::n] for i in range(n)]
            starts = Counter(p[i : i + window] for p in parts for i in range(len(p) - window + 1))
            want = [[i for i in range(len(p) - window + 1) if starts[p[i : i + window]] > 1] for s in shards for p in s]
            assert [x.tolist() for x in suffix_dedup.repeated(shards, window, 5)] == want


def test_numbers_of_symbols_are_exact(monkeypatch):
    data = bytes(random.Random(1).choices(b"abc", k=400))
    monkeypatch.setattr(suffix_dedup, "byte_grams", lambda d, size, seed: np.zeros(len(d) - size + 1, np.uint64))  # every hash collides
    of = suffix_dedup.numbered(data, 9, 1)
    assert len(set(of.tolist())) == len({data[i : i + 9] for i in range(len(data) - 8)})
