"""Operators do the whole job also with other parameters and tables than the registered ones."""

import numpy as np
import pytest

from graphloam.llm import decontaminate, license_scan, vector_dedup


def sparse_shards() -> tuple[list, list]:
    """Three shards of 1500 vectors with some isolated pairs, in them and across."""
    rng = np.random.default_rng(11)
    n = 1500
    free = np.setdiff1d(np.arange(n), np.linspace(0, n - 1, vector_dedup.AUDIT).astype(int))
    shards = [rng.normal(size=(n, 64)) for _ in range(3)]
    for a, b in ((0, 1), (1, 2), (0, 2)):
        shards[b][rng.choice(free, 60, replace=False)] = shards[a][rng.choice(free, 60, replace=False)] + rng.normal(size=(60, 64)) * 0.1
    shards[0][free[1000:1060]] = shards[0][free[:60]] + rng.normal(size=(60, 64)) * 0.1
    x = [vector_dedup.unit(s) for s in shards]
    return x, [vector_dedup.Graph(u.astype(np.float32), n * i + np.arange(n)) for i, u in enumerate(x)]


def test_searches_find_isolated_pairs(monkeypatch):
    """Where no audited row has a link, the searches decide; narrow beams that find nothing are noticed and widened."""
    x, graphs = sparse_shards()
    hits = vector_dedup.Graph.hits
    for patched in (hits, lambda self, queries, least, width: hits(self, queries, least, width) if width > 100 else []):
        monkeypatch.setattr(vector_dedup.Graph, "hits", patched)
        for i in range(3):
            for j in range(i, 3):
                true = vector_dedup.all_links(x[i], None if i == j else x[j])
                found, seen, right = vector_dedup.found_links(x[i], graphs[i], *((None, None) if i == j else (x[j], graphs[j])))
                assert (true.sum() >= 50 or i == j > 0) and not (found & ~true).any()
                assert (found & true).sum() >= 0.99 * true.sum() and right >= 0.999 * seen > 0


def test_searches_that_find_nothing_stop_the_job(monkeypatch):
    x, graphs = sparse_shards()
    monkeypatch.setattr(vector_dedup.Graph, "hits", lambda self, queries, least, width: [])
    with pytest.raises(RuntimeError, match="widest beam"):
        vector_dedup.found_links(x[0], graphs[0], x[1], graphs[1])


def test_vectors_exact_by_parameter(spark):
    x, _ = sparse_shards()
    rows = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x[0])], "vec_id long, label int, embedding array<double>")
    one, two = ({r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(rows, shard=600, exact=e).collect()} for e in (False, True))
    true = vector_dedup.all_links(x[0], None)
    assert {k: n for k, (n, _) in two.items()} == dict(enumerate(true.sum(1).tolist()))
    assert sum(one[k] != two[k] for k in two) <= 2


def test_phrases_and_templates_of_one_word():
    scanner = license_scan.Scanner([("x", "XLIC"), ("two", "two words"), ("mit", "Released under the MIT License, XLIC")], {"gpl": "gpl-any"})
    assert scanner.scan(b"GPL")[:6] == (1, 1, 0, 0, "gpl-any", "gpl-any")
    assert scanner.scan(b"zz gpl zz gpl")[1:6] == (2, 1, 3, "gpl-any", "gpl-any")
    assert scanner.scan(b"zz xlic zz")[1:] == (0, None, None, "", "x", 1.0, [{"label": "x", "first": 1, "end": 2, "cover": 1.0}])
    assert scanner.scan(b"zz two words")[5] == "two" and scanner.scan(b"two zz words")[5] == ""
    assert scanner.scan(b"released under the mit license xlic gpl")[5] == "gpl-any,mit,x"


def test_items_lie_in_partitions_of_their_size():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, n)).encode() for n in (2, 5, 6, 9, 30, 31, 200, 900)]
    index = decontaminate.ItemIndex(list(enumerate(texts)))
    parts = {size: [sorted(set(p[2].tolist())) for p in held] for size, held in index.sketch.items()}
    assert parts == {2: [[0]], 5: [[1], [2], [3], [4, 5], [6], [7]]}
    assert all(bound == keys[-1] for held in index.sketch.values() for bound, keys, _ in held)
    got = {(d, i) for d, i, _ in index.search([b"a b " + t + b" c" for t in texts])}
    assert got == {(i, i) for i in range(len(texts))}
