"""Words that are built to agree under the public hashes must not link documents."""

import random

import numpy as np
import pytest

import corpus_pipeline
from graphloam.llm import jaccard_join
from graphloam.llm.common import SEEDS, Words, hash_words, keyed_words, new_keys

ALLOWED = b"abcdefghijklmnopqrstuvwxyz0123456789"


def colliding(n: int, seed: int) -> list[tuple[str, str]]:
    """Pairs of words of 16 letters and digits with one hash_words() under SEEDS[seed]: the second lanes make good the difference
    of the states after the first ones."""
    rng = random.Random(seed)
    first = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)).encode() for _ in range(6000)]
    key = SEEDS[seed]
    lane = np.array([int.from_bytes(w, "little") for w in first], np.uint64)
    h = (np.full(len(lane), 17, np.uint64) * key ^ lane) * np.uint64(0xFF51AFD7ED558CCD) + key
    state = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    of = {a ^ b: (a, b) for a in ALLOWED for b in ALLOWED}
    order = np.argsort(state & np.uint64(0x8080808080808080), kind="stable")
    out = []
    for i, a in enumerate(order.tolist()):
        for b in order[i + 1 : i + 24].tolist():
            difference = int(state[a] ^ state[b]).to_bytes(8, "little")
            if all(x in of for x in difference):
                second = [bytes(of[x][side] for x in difference) for side in (0, 1)]
                out.append(((first[a] + second[0]).decode(), (first[b] + second[1]).decode()))
                if len(out) == n:
                    return out
    raise AssertionError("too few pairs")


@pytest.mark.parametrize("seed", [0, 1])
def test_built_words_link_nothing(spark, seed):
    pairs = colliding(40, seed)
    left, right = (" ".join(p[side] for p in pairs) for side in (0, 1))
    a, b = Words([left.encode(), right.encode()]), len(pairs)
    hashes = a.hash if seed == 0 else a.second()
    assert (hashes[:b] == hashes[b:]).all() and not set(left.split()) & set(right.split())  # the public hash is fooled
    rows = spark.createDataFrame([(1, left), (2, right), (3, left + " more")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(rows).collect()} == {1: 1, 2: 2, 3: 1}
    stay = corpus_pipeline.near_duplicate_stage(spark, rows, "")
    assert sorted(r.doc_id for r in stay.collect()) == [1, 2]


def test_keyed_words_are_siphash():
    data = bytes(range(64))
    ends = np.arange(65)
    key = tuple(int.from_bytes(bytes(range(i, i + 8)), "little") for i in (0, 8))
    found = keyed_words(data, np.zeros(65, np.int64), ends, key)
    # fixed values: published test vectors of SipHash-2-4 for 0, 1, 7, 8 and 15 bytes
    assert [hex(found[i]) for i in (0, 1, 7, 8, 15)] == ["0x726fdb47dd0e0e31", "0x74f839c593dc67fd", "0xab0200f58b01d137", "0x93f5f5799a932462", "0xa129ca6149be45e5"]
    long = b"x" * 100
    one, other = (keyed_words(long, np.array([0, 1]), np.array([99, 100]), k)[0] for k in new_keys())
    assert one != other and len(np.unique(hash_words(long, np.array([0]), np.array([99])))) == 1
