"""Links of sets so small that one of the two may lack nothing: it lies within the larger one."""

import random

from test_pair_operators import brute_components

from graphloam.llm import jaccard_join


def test_sets_within_larger_ones(spark):
    rng = random.Random(5)
    rows = []
    for k in range(0, 240, 3):
        w = [f"w{k}x{i}" for i in range(rng.randrange(4, 14))]
        rows += [(k, " ".join(w)), (k + 1, " ".join([*w, "more"])), (k + 2, " ".join(["less", *w] if rng.random() < 0.5 else [*w, "more", "still"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"shingle": 5, "num": 80, "den": 100}):
        found = sorted(tuple(r) for r in jaccard_join.jaccard_components(df, **options).collect())
        assert found == sorted(brute_components(rows, *options.values()))
        # six shingles within seven at 0.85, four within five at 0.8
        least = 6 if not options else 4
        assert any(n == least and c < k for k, n, c in found) or any(n == least + 1 and c < k for k, n, c in found)
