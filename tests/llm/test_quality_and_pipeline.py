import random

import numpy as np
from llm_words import words
from pyspark.sql import functions as F
from test_pair_operators import brute_components, brute_contained

import corpus_pipeline
from graphloam.llm import decontaminate, quality
from graphloam.llm.common import Durable

DATA = "/root/testdata/sf0.01"


def test_decisions_on_labelled_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.op4_quality(spark, DATA).join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    low = [r for r in rows if r["quality"] == 0]
    assert sum(r["keep"] for r in good) / len(good) > 0.97 and sum(not r["keep"] for r in low) / len(low) > 0.95
    assert quality.op4_quality(spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    rows = quality.score(docs, labels.where(~held), path=F.col("lang")).join(labels.where(held), "doc_id").collect()
    clean = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    low, toxic = [r for r in rows if r["quality"] == 0], [r for r in rows if r["toxic"] == 1]
    assert sum(r["keep"] for r in clean) / len(clean) > 0.97
    assert sum(not r["keep"] for r in low) / len(low) > 0.95 and sum(not r["keep"] for r in toxic) / len(toxic) > 0.75


def test_sites_shrink_toward_the_global_rate(spark):
    """The same text gets a worse posterior at a bad site, and a site of one document hardly differs from the average."""
    rng = random.Random(1)
    good, bad = ["calm plain words in a row"] * 4, ["%%% $$$ !!! ### @@@ ~~~"] * 4
    rows, labels = [], []
    for k in range(600):
        site = "bad.org/x" if k % 3 == 0 else "good.org/y"
        is_bad = rng.random() < (0.9 if site[0] == "b" else 0.05)
        words_ = [*rng.choice(bad if is_bad else good).split(), *(f"w{rng.randrange(50)}" for _ in range(8))]
        rows.append((k, " ".join(words_), site))
        labels.append((k, int(not is_bad), 0))
    probe = "w1 w2 w3 %%% plain words w4"
    rows += [(1000, probe, "bad.org/x"), (1001, probe, "good.org/y"), (1002, probe, "lonely.org/z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["p_low"] for r in quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("doc_id >= 1000").collect()}
    assert out[1000] > out[1002] > out[1001]


def test_quality_edges(spark, odd_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["keep"] for r in quality.score(odd_documents, none).collect())
    some = spark.createDataFrame([(1, 1, 0), (2, 0, None), (2, 1, 0), (None, 0, 1), (3, None, 1), (7, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(odd_documents, some).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["p_low"] <= 1 and 0 <= r["p_toxic"] <= 1 for r in rows)
    assert quality.score(odd_documents.limit(0), some).count() == 0
    host, path = quality.site_columns(F.col("u"))
    urls = spark.createDataFrame([("https://a.org/b/c?d",), ("src1",), (None,), ("http://a.org",)], "u string").select(host.alias("h"), path.alias("p")).collect()
    assert [tuple(r) for r in urls] == [("a.org", "a.org/b"), ("src1", "src1"), ("", ""), ("a.org", "a.org")]


def test_one_row_stays_one_row(spark):
    """Queries of a URL are no part of its site, and no row is doubled or lost; repeated keys don't widen the sample."""
    rows = [(k % 150, f"plain text number {k} {'%%% !!!' if k % 5 == 0 else 'words'}", "https://a.org" if k % 2 else f"https://a.org?page={k % 3}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(100)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, labels).count() == 200
    assert quality._sample(docs, labels, "doc_id", "text", 7).count() <= 7
    many = docs.unionByName(docs).unionByName(docs)
    assert quality._sample(many, labels, "doc_id", "text", 7).collect() == quality._sample(docs, labels, "doc_id", "text", 7).collect()


def brute_posteriors(rows, labels, heads, path):
    """The hierarchy in plain Python over dicts."""
    told = {}
    for k, q, t in labels:
        if k is not None:
            old = told.get(k, (q, t))
            told[k] = (min(q, old[0]), max(t, old[1]))
    evidence = {h: heads[i].logit(quality.text_features([(t or "").encode() for _, t, *_ in rows])) for i, h in enumerate(quality.HEADS)}
    out = [[] for _ in rows]
    for i, head in enumerate(quality.HEADS):
        share, host, site = [], {}, {}
        for n, (k, _, source, lang) in enumerate(rows):
            y = (1 - told[k][0], told[k][1])[i] if k in told else 1 / (1 + np.exp(-evidence[head][n]))
            share.append(y)
            a = (source or "").split("?")[0].removeprefix("https://").split("/")[0]
            b = a + "/" + lang if path else "/".join((source or "").split("?")[0].removeprefix("https://").split("/")[:2])
            host.setdefault(a, []).append(n)
            site.setdefault((a, b), []).append(n)
        total = lambda ns: sum(share[n] for n in ns)
        base = min(1 - 1e-6, max(1e-6, sum(share) / len(share)))

        def strength(groups, prior):
            n = np.array([len(g) for g in groups.values()], float)
            rate, p = np.array([total(g) for g in groups.values()]) / n, np.array([prior(g) for g in groups])
            spread = (n * (rate - p) ** 2).sum() / n.sum() - (p * (1 - p)).sum() / n.sum()
            return max(20.0, min(1e4, (n * p * (1 - p)).sum() / n.sum() / max(spread, 1e-6)))

        of_hosts = strength(host, lambda g: base)
        of_paths = strength(site, lambda g: min(1 - 1e-6, max(1e-6, total(host[g[0]]) / len(host[g[0]]))))
        for (a, _), members in site.items():
            for n in members:
                at_host = (total(host[a]) - share[n] + of_hosts * base) / (len(host[a]) - 1 + of_hosts)
                at_path = (total(members) - share[n] + of_paths * at_host) / (len(members) - 1 + of_paths)
                p = min(1 - 1e-6, max(1e-6, at_path))
                out[n].append(1 / (1 + np.exp(-(evidence[head][n] + np.log(p / (1 - p)) - np.log(base / (1 - base))))))
    return out


def test_posteriors_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source", "lang")
    rng = random.Random(6)
    rows = [(r["doc_id"] if rng.random() < 0.9 else None, r["text"], rng.choice(["https://a.org/x/1", "https://a.org/y?q=1", "https://b.org", r["source"]]), r["lang"] or "") for r in docs.collect()]
    rows += rows[:20]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()]
    labels += [(labels[0][0], 0, 1), (None, 0, 1)]
    df, known = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    heads = quality.fit(df, known, Durable(spark))
    for path in (None, F.col("lang")):
        brute = brute_posteriors(rows, labels, heads, path is not None)
        expected = sorted(((str(r[0]), *(round(float(p), 6) for p in ps), all(p <= 0.5 for p in ps)) for r, ps in zip(rows, brute, strict=True)))
        mine = sorted((str(r["doc_id"]), round(r["p_low"], 6), round(r["p_toxic"], 6), r["keep"]) for r in quality.score(df, known, path=path).collect())
        assert [m[0] for m in mine] == [e[0] for e in expected] and np.allclose([m[1:3] for m in mine], [e[1:3] for e in expected], atol=2e-5)
        assert [m[3] for m in mine] == [e[3] for e in expected]


def test_logistic_regression_finds_the_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0, 0.0])))).astype(float)
    assert np.allclose(quality.fit_logistic(x, y), [0.5, 1.0, -2.0, 0.0], atol=0.2)
    assert np.isfinite(quality.fit_logistic(x, np.zeros(4000))).all()


def test_stages_against_brute_force(spark):
    """Every stage on what its predecessor kept; the first one by its own decisions, the others by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf_dir = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "substring_dedup", "decontamination", "sentencepiece"]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    one = stages["quality"](spark, docs, sf_dir).cache()
    assert one.columns == docs.columns
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = rows(one)
    clean = [k for k, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(k in kept for k in clean) / len(clean) > 0.95

    two = stages["near_duplicates"](spark, one, sf_dir).cache()
    groups = brute_components(list(kept.items()), 5, 80, 100)
    assert two.columns == docs.columns and set(rows(two)) == {k for k, _, c in groups if k == c}

    three = stages["substring_dedup"](spark, two, sf_dir).cache()
    seen, expected = {}, {}
    for k, t in sorted(rows(two).items()):
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            f = seen.setdefault(tuple(w[i : i + 13]), k)
            if f < k:
                gone.update(range(i, i + 13))
        expected[k] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    assert three.columns == docs.columns and rows(three) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())

    four = stages["decontamination"](spark, three, sf_dir).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in brute_contained(list(expected.items()), items)}
    assert set(rows(four)) == set(expected) - leaks

    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    five = {r["doc_id"]: list(r["token_ids"]) for r in stages["sentencepiece"](spark, four, sf_dir).collect()}
    assert five == {k: sp.encode(t) for k, t in rows(four).items()}
    whole = {r["doc_id"]: list(r["token_ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == five


def test_stages_on_odd_and_empty_rows(spark, odd_documents, tmp_path):
    spark.createDataFrame([(1, 1, 0), (7, 0, 1), (8, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a shared passage of more than thirteen words that stands"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_documents, odd_documents.limit(0)):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            before = now.count()
            now = stage(spark, now, str(tmp_path)).cache()
            assert now.count() <= before
            if name != "sentencepiece":
                assert now.columns == docs.columns and now.dtypes == docs.dtypes
    assert decontaminate.K == 5


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """A missing or repeated doc_id shields no row from a decision and condemns no other."""
    item = "which of these seven planets has the largest number of known moons today"
    good = [" ".join(f"calm{(7 * i + j) % 40} plain{(3 * i + j) % 11} words" for j in range(14)) for i in range(120)]
    bad = [" ".join(f"%%%{(5 * i + j) % 9} !!!! @@@{j}" for j in range(14)) for i in range(120)]
    rows = [(i, t) for i, t in enumerate(good)] + [(200 + i, t) for i, t in enumerate(bad)]
    labels = [(k, int(k < 200), 0) for k, _ in rows]
    one = "a quiet evening by the river where nobody spoke about anything of importance for hours " + good[3]
    rows += [(500, one), (500, one), (None, one), (None, bad[0] + " @@@"), (501, bad[1] + " %%%"), (501, "another calm text of plain words about rivers and hills " + good[5]), (None, "calm words " + item + " plain words " + good[9]), (502, "more calm words " + good[11]), (502, item + " and calm plain words " + good[20])]
    docs = spark.createDataFrame([(k, t, "s", "en") for k, t in rows], "doc_id long, text string, source string, lang string")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    kept = texts(stages["quality"](spark, docs, str(tmp_path)))
    assert stages["quality"](spark, docs.drop("lang"), str(tmp_path)).columns == ["doc_id", "text", "source"]
    assert not any("@@@" in t for _, t in kept) and {t for _, t in rows if "@@@" not in t} == {t for _, t in kept}
    left = texts(stages["near_duplicates"](spark, docs, str(tmp_path)))
    assert [t for _, t in left].count(one) == 1 and [t for k, t in left if k == "501"] == [rows[-4][1]]
    clean = texts(stages["decontamination"](spark, docs, str(tmp_path)))
    assert not any(item in t for _, t in clean) and len(clean) == len(rows) - 2
