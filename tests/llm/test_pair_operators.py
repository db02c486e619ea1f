import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_words import words
from pyspark.sql import functions as F

from graphloam.llm import decontaminate, jaccard_join, sharding, substring_dedup, vector_dedup

DATA = "/root/testdata/sf0.001"


# --------------------------------------------------------------------------------------------------- substring dedup


def brute_dedup(rows, window=13):
    first = {}
    split = [(k, words(t)) for k, t in rows]
    for k, w in split:
        if k is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, k), k)
    out = []
    for k, w in split:
        gone = set()
        if k is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < k:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run_dedup(df, **options):
    out = substring_dedup.dedup(df, **options)
    return sorted(((r["doc_id"], r["__n_words"], r["__n_removed"], hashlib.sha256(r["__kept"].encode()).hexdigest()) for r in out.collect()), key=str)


def passages(seed, n):
    """Texts that share passages, with repeats inside a text, short texts and copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))] for _ in range(6)]
    rows = []
    for k in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            w += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(25))]
            if rng.random() < 0.1:
                w += ["again"] * 40
        rows.append((k, " ".join(w)))
    return [*rows, (n, rows[0][1]), (3, rows[5][1]), (None, rows[7][1]), (n + 1, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_against_brute_force(spark, monkeypatch, seed):
    rows = passages(seed, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run_dedup(df) == brute_dedup(rows)
    assert run_dedup(df, window=6, k=3) == brute_dedup(rows, 6)


def test_substring_dedup_on_odd_rows(spark, odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert run_dedup(odd_documents) == brute_dedup(rows)
    out = substring_dedup.dedup(odd_documents)
    assert out.columns[: len(odd_documents.columns)] == odd_documents.columns
    assert {r["bucket"] for r in out.collect()} == {"clash"}
    spans = {r["doc_id"]: r["__spans"] for r in out.collect() if r["doc_id"] == 2}
    assert [(s["first"], s["end"]) for s in spans[2]] == [(0, len(words(rows[1][1])) - 1)]
    assert substring_dedup.dedup(odd_documents.limit(0)).count() == 0
    again = substring_dedup.dedup(substring_dedup.dedup(odd_documents.withColumn("__bucket", F.lit(5)).withColumn("__kept", F.lit("mine"))))
    assert again.columns == [*odd_documents.columns, "__bucket", "__n_words", "__n_removed", "__spans", "__kept"]
    assert {r["__bucket"] for r in again.collect()} == {5}


def mirror(n):
    """A word over two letters and its complement that every polynomial modulo a power of two takes for the same."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_of_one_polynomial_differ(spark):
    for n in (32, 64, 128, 1024):
        a, b = mirror(n)
        tail = " " + " ".join(f"t{i}" for i in range(12))
        df = spark.createDataFrame([(1, a + tail), (2, b + tail), (3, a), (4, b)], "doc_id long, text string")
        assert [r[2] for r in run_dedup(df)] == [0, 0, 0, 0]
        components = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df.where("doc_id > 2")).collect()}
        assert components == {3: 3, 4: 4}


def test_passage_of_very_many_documents(spark):
    """Its anchors are hot: their windows are dealt by their content."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(k, " ".join(f"x{k}y{i}" for i in range(8)) + f" {passage} " + " ".join(f"z{k % 7}y{i}" for i in range(8))) for k in range(1300)]
    assert run_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_dedup(rows)


def test_parse_of_a_block():
    rng = random.Random(9)
    for _ in range(30):
        keys = np.array([rng.randrange(6) for _ in range(12)])
        texts = [[rng.choice("abc") for _ in range(rng.randrange(4, 14))] for _ in keys]
        block = substring_dedup.Block(keys, np.array([len(t) for t in texts]), [w.encode() for t in texts for w in t], 4)
        first, end = block.parse()
        brute = []
        for k, t in zip(keys, texts, strict=True):
            earlier = {tuple(o[i:j]) for q, o in zip(keys, texts, strict=True) if q < k for i in range(len(o)) for j in range(i + 1, len(o) + 1)}
            at = 0
            while at <= len(t) - 4:
                size = max((n for n in range(4, len(t) - at + 1) if tuple(t[at : at + n]) in earlier), default=0)
                brute += [(len(brute), at, at + size)] if size else []
                at += size or 1
        starts = block.begin[block.segment[first]]
        order = np.argsort(first)
        assert list(zip((first - starts)[order].tolist(), (end - starts)[order].tolist(), strict=True)) == [(a, b) for _, a, b in brute]


def test_substring_dedup_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    mine = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op10_substring_dedup(spark, DATA).collect()), key=str)
    assert mine == brute_dedup(docs)


# ------------------------------------------------------------------------------------------------------ Jaccard join


def brute_components(rows, size=4, num=85, den=100):
    sets = []
    for k, t in rows:
        w = words(t, lower=True)
        sets.append((k, frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()))
    keys = sorted({k for k, _ in sets if k is not None})
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    live = [(k, s) for k, s in sets if k is not None and s]
    for i, (a, x) in enumerate(live):
        for b, y in live[:i]:
            both = len(x & y)
            if den * both >= num * (len(x) + len(y) - both):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return sorted(((k, len(s), None if k is None else root(k)) for k, s in sets), key=str)


def family(seed, n):
    """Texts with few and many edits of common bases, shorter texts, copies, and a line that most of them share."""
    rng = random.Random(seed)
    bases = [[f"b{j}x{i}" for i in range(rng.randrange(30, 200))] for j in range(6)]
    rows = []
    for k in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.6:
            w += "the line that very many texts share at their end".split()
        rows.append((k, " ".join(w) if rng.random() < 0.9 else " ".join(w[: rng.randrange(6)])))
    return [*rows, (n, rows[0][1].upper()), (n + 1, rows[0][1]), (n + 2, None), (None, rows[0][1]), (n + 3, "Only Two"), (n + 4, "only two"), (n + 5, " ")]


@pytest.mark.parametrize(("seed", "block"), [(1, 128), (2, 5)])
def test_jaccard_components_against_brute_force(spark, seed, block):
    rows = family(seed, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    mine = sorted((tuple(r) for r in jaccard_join.jaccard_components(df, block=block).collect()), key=str)
    assert mine == brute_components(rows)
    mine = sorted((tuple(r) for r in jaccard_join.jaccard_components(df, shingle=5, num=80, den=100, block=block).collect()), key=str)
    assert mine == brute_components(rows, 5, 80, 100)


def test_classes_of_several_blocks(spark):
    """A dense group, and a chain whose ends only meet through its middle, both larger than a block."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for k in range(60):
        w = list(base)
        w[rng.randrange(80)] = f"e{k}"
        rows.append((k, " ".join(w)))
    for k in range(60):  # neighbours share most words, others few
        rows.append((1000 + 2 * k, " ".join(f"c{i}" for i in range(3 * k, 3 * k + 70))))
        rows.append((1001 + 2 * k, " ".join(f"c{i}" for i in range(3 * k + 400, 3 * k + 440))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (7, 20):
        assert sorted((tuple(r) for r in jaccard_join.jaccard_components(df, block=block).collect()), key=str) == brute_components(rows)


def test_jaccard_on_odd_rows(spark, odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    mine = sorted((tuple(r) for r in jaccard_join.jaccard_components(odd_documents).collect()), key=str)
    assert mine == brute_components(rows)
    assert jaccard_join.jaccard_components(odd_documents.limit(0)).count() == 0


def test_links_in_one_block():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 80, dtype=np.int64).view(np.uint64)
    sets = [np.unique(np.concatenate([base[: 80 - i], rng.integers(0, 1 << 62, i // 2, dtype=np.int64).view(np.uint64)])) for i in range(0, 40, 2)]
    true = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    found = jaccard_join.links(sets, 0, 85, 100)
    assert set(found) <= true

    def classes(edges):
        f = jaccard_join.Forest(len(sets))
        for i, j in edges:
            f.join(i, j)
        return [f.root(i) for i in range(len(sets))]

    assert classes(found) == classes(sorted(true))


# -------------------------------------------------------------------------------------------------- decontamination


def brute_contained(docs, items, k=5):
    out = []
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    for i, t in items:
        w = words(t, pattern, lower=True)
        n = min(k, len(w))
        own = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if w else set()
        for d, text in docs:
            v = words(text, pattern, lower=True)
            shared = len(own & {tuple(v[p : p + n]) for p in range(len(v) - n + 1)}) if own else 0
            if own and 5 * shared >= 4 * len(own):
                out.append((d, i, shared, len(own)))
    return sorted(out, key=str)


def test_contained_items_against_brute_force(spark, monkeypatch, odd_documents):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    mine = sorted(((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontaminate.op5_decontamination(spark, DATA).collect()), key=str)
    assert mine == brute_contained(docs, items) and mine

    rng = random.Random(4)
    pool = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))) for i in range(30)] + [(99, None), (98, "!!"), (None, "t1 t2 t3 t4 t5 t6"), (3, "t1")]
    docs = []
    for d in range(60):
        w = [rng.choice(pool) for _ in range(rng.randrange(60))]
        part = (items[rng.randrange(30)][1] or "").split()
        if len(part) > 6 and rng.random() < 0.5:
            part[rng.randrange(len(part))] = "edited"
        docs.append((d, " ".join([*w, *part, *w[:5]]).replace("t1 ", "T1, ")))
    docs += [(None, items[2][1]), (7, None)]
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 7)
    found = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in found.collect()), key=str) == brute_contained(docs, items)
    few = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), few.unionByName(few)).count() == found.count()
    kept = decontaminate.without_contained(spark.createDataFrame(docs, "doc_id long, text string"), few)
    leaks = Counter(d for d, *_ in {(d, i) for d, i, *_ in brute_contained(docs, items)})
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(((d, t) for d, t in docs if d not in leaks or (d == 7 and t is None)), key=str)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(odd_documents, empty).count() == 0
    assert decontaminate.contained_items(odd_documents.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# --------------------------------------------------------------------------------------------------------- sharding


def test_shards(spark, odd_documents):
    import zlib

    data = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = sharding.op8_sharding(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    load, places = Counter(), {}
    for r in rows:
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert set(load) == set(range(16)) and max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 16
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    slot_of = {r["__key"]: r["virtual_slot"] for r in sharding.with_slots(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert {r["doc_id"]: r["virtual_slot"] for r in rows} == slot_of
    shards_of = {}
    for r in rows:
        shards_of.setdefault(r["virtual_slot"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in shards_of.values())  # the map decides
    out, _ = sharding.shard(odd_documents, 4)
    odd = out.collect()
    assert len(odd) == odd_documents.count()
    for s in {r["shard"] for r in odd}:
        mine = sorted(r["slot"] for r in odd if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert sharding.shard(odd_documents.limit(0))[0].count() == 0


@pytest.mark.parametrize("weights", [[random.Random(n).lognormvariate(7, sigma) for _ in range(2000)] for n, sigma in enumerate((0.5, 1.5, 2.0))] + [[random.Random(7).paretovariate(1.2) * 100 for _ in range(4000)]])
def test_moved_slots_balance_as_well_as_a_new_map(weights):
    w = [int(x) for x in weights]
    even = sharding.SlotMap([s % 16 for s in range(len(w))], 16)
    load = lambda m: max(sum(x for x, s in zip(w, m.shard_of, strict=True) if s == k) for k in range(16)) / (sum(w) / 16)
    new = even.rebalance(w)
    assert load(new) <= max(1.001, 1.001 * load(sharding.SlotMap.build(w, 16)))
    assert new.rebalance(w).shard_of == new.shard_of


def test_the_query_edits_its_stored_map(spark, tmp_path):
    """Two calls on a table that has grown between them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = []
    for part in (docs.where("doc_id % 3 = 0"), docs):
        part.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        rows = sharding.op8_sharding(spark, str(tmp_path)).collect()
        load = Counter()
        for r in rows:
            load[r["shard"]] += r["size"]
        assert max(load.values()) <= max(1.001 * sum(load.values()) / 16, 1 + max(r["size"] for r in rows))
        found.append((rows[0]["map_version"], {r["doc_id"]: r["shard"] for r in rows}))
    (one, before), (two, after) = found
    assert two > one and sum(after[k] == s for k, s in before.items()) > 0.5 * len(before)  # most rows stay where they are
    assert sharding.op8_sharding(spark, str(tmp_path)).first()["map_version"] == two


def test_slot_map_versions(spark, tmp_path):
    rng = random.Random(2)
    weights = [rng.randrange(1000) for _ in range(2000)]
    one = sharding.SlotMap.build(weights, 16)
    loads = lambda m: [sum(w for w, s in zip(weights, m.shard_of, strict=True) if s == k) for k in range(m.shards)]
    two = one.rebalance(weights, 17)
    moved = [b for a, b in zip(one.shard_of, two.shard_of, strict=True) if a != b]
    assert two.version == 2 and set(moved) == {16} and max(loads(two)) - min(loads(two)) < 2000
    three = two.rebalance(weights, 15)
    assert max(three.shard_of) == 14 and max(loads(three)) - min(loads(three)) < 2500
    assert one.rebalance(weights).shard_of == one.shard_of
    path = str(tmp_path / "maps")
    for m in (one, two, three):
        m.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == three and sharding.SlotMap.load(spark, path, 1) == one
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at, sizes = str(tmp_path / "dealt"), lambda d: sharding.slot_table(sharding.with_slots(d))[0]
    assert sharding.deal(spark, sizes(docs), 5, at).version == 1 and sharding.deal(spark, sizes(docs), 5, at).version == 1
    grown = sharding.deal(spark, sizes(docs.unionByName(docs.limit(100))), 6, at)
    assert grown.version == 2 and max(grown.shard_of) == 5 and [v for v, _ in grown.history] == [1, 2]
    equal = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(20_000))))
    rows, _ = sharding.shard(equal, 4)
    held = Counter((r["shard"]) for r in rows.collect())
    assert sum(held.values()) == 20_000 and max(held.values()) - min(held.values()) < 100
    assert sharding.shard(docs.withColumnRenamed("doc_id", "slot"), 2, key="slot")[0].columns[0] == "key"
    again, used = sharding.shard(docs, slot_map=sharding.SlotMap.build([1] * sharding.SLOTS, 3))
    assert used.shards == 3 and {r["shard"] for r in again.collect()} <= {0, 1, 2}


# ---------------------------------------------------------------------------------------------------------- vectors


def brute_vectors(rows):
    out = []
    unit = {}
    for i, (_, e, label) in enumerate(rows):
        if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.array(e, float)
            unit[i] = v / np.linalg.norm(v)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = Counter()
    for i in unit:
        for j in unit:
            if j < i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98 - 1e-12:
                n[i] += 1
                n[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (k, *_) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    for i, (k, *_) in enumerate(rows):
        out.append((k, n[i], least[root(i)], k == least[root(i)]))
    return sorted(out)


@pytest.mark.parametrize("shard", [8192, 60])
def test_vectors_against_brute_force(spark, shard):
    rng = np.random.default_rng(7)
    rows, centres = [], rng.normal(size=(12, 16))
    for k in range(400):
        c = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.15, 1.0])
        rows.append((k, [float(x) for x in (c * rng.choice([1.0, 50.0])).astype(np.float32)], int(k % 3)))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    nan = float("nan")
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [nan] * 16, 0), (2004, [None] + [1.0] * 15, 0), (2005, rows[5][1], None), (2006, rows[5][1][:8], rows[5][2]), (2007, [float("inf")] * 16, 0), (2008, [1e-30] * 16, 1), (2009, [1e-30] * 16, 1), (2010, [1e30] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash")).repartition(4)
    report = {}
    mine = sorted(tuple(r) for r in vector_dedup.near_duplicates(df, shard=shard, report=report).collect())
    assert mine == brute_vectors(rows)
    assert report["true"] > 100 and report["recall"] >= 0.99
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_graphs():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    x = np.concatenate([centres[rng.integers(60, size=2500)] + rng.normal(size=(2500, 32)) * rng.choice([0.05, 0.1, 0.6], size=(2500, 1)), centres[0] + rng.normal(size=(600, 32)) * 0.02])
    u = vector_dedup.unit(x)
    graph = vector_dedup.Graph(u.astype(np.float32), np.arange(len(x)))
    again = vector_dedup.Graph.load(graph.x, graph.dump())
    assert again.entry == graph.entry and all((a == b).all() for a, b in zip(again.levels, graph.levels, strict=True))
    found, seen, right = vector_dedup.found_links(u, again, None, None)
    assert seen >= vector_dedup.AUDIT and right >= vector_dedup.TARGET * seen
    true = u @ u.T >= 0.98
    np.fill_diagonal(true, False)
    assert not (found & ~true).any() and (found & true).sum() >= 0.99 * true.sum()
