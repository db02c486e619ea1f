"""A search's memory does not follow the length of a batch of rows."""

import tracemalloc

import numpy as np

from graphloam.operators.vectors import _nearest


def test_memory_of_a_long_batch():
    rng = np.random.default_rng(3)
    rows, queries = rng.normal(size=(20_000, 16)), rng.normal(size=(600, 16))
    tracemalloc.start()
    q, keys, sims = _nearest(np.arange(20_000), rows, queries, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # 512 queries with all rows at once were more than 160 MB
    near = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (rows / np.linalg.norm(rows, axis=1)[:, None]).T
    assert (keys.reshape(600, 5) == np.argsort(-near, axis=1)[:, :5]).all() and (q == np.repeat(np.arange(600), 5)).all()
