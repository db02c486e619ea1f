import random
import re
import zlib

import public_tokenizers
import pytest
from llm_words import words
from pyspark.sql import functions as F

from graphloam.llm import language_id, license_scan, sentencepiece_codec, token_counts

DATA = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def noise(seed, n, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, documents_pd, odd_documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    count = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    for rows in (token_counts.op2_token_counts(spark, DATA).collect(), token_counts.token_counts(odd_documents, BPE).collect()):
        assert rows
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in token_counts.op2_token_counts(spark, DATA).collect():
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (count(texts[r["doc_id"]]), len(texts[r["doc_id"]].encode()), count(texts[r["doc_id"]]) > 1024)
    odd = token_counts.token_counts(odd_documents.withColumn("doc_id", F.monotonically_increasing_id()), BPE).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in odd] == [count(r["text"]) for r in odd_documents.collect()]
    assert token_counts.token_counts(odd_documents.limit(0), BPE).count() == 0


@pytest.mark.parametrize("chunk", [3, 7, 1 << 16])
def test_chunk_maps_compose(monkeypatch, chunk):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    t, lib = token_counts.transducer(BPE), Tokenizer.from_file(BPE)
    for s in noise(chunk, 600, [*"ab 'st\n\t l1é　\x1c\x85日!\r", "<|endoftext|>", "   ", "'ll", "hello", " the", "日本語の", "12", "==", "''"]):
        assert t.count(s) == len(lib.encode(s, add_special_tokens=False).ids), repr(s)


def test_restarted_tables_give_the_same_counts(monkeypatch):
    t = token_counts.Transducer(BPE)
    texts = noise(1, 200, ["the ", "token", "ization ", "é", "xyz ", "12"])
    expected = [t.count(s) for s in texts]
    monkeypatch.setattr(token_counts, "TRANSITIONS", 50)
    monkeypatch.setattr(token_counts, "MEMO", 10)
    assert [t.count(s) for s in texts] == expected


def test_pieces_equal_the_library(spark, documents_pd, odd_documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = dict(zip(documents_pd.doc_id, documents_pd.text, strict=True))
    out = sentencepiece_codec.op7_sentencepiece(spark, DATA)
    rows = out.collect()
    assert len(rows) == len(texts) and all(list(r["token_ids"]) == sp.encode(texts[r["doc_id"]]) and r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(out, PIECES).collect()}
    assert back == texts
    odd = sentencepiece_codec.encode(odd_documents.withColumn("doc_id", F.monotonically_increasing_id()), PIECES).orderBy("doc_id").collect()
    assert [list(r["token_ids"]) for r in odd] == [sp.encode(r["text"] or "") for r in odd_documents.collect()]
    assert [r["round_trip"] for r in odd] == ["▁" not in (r["text"] or "") for r in odd_documents.collect()]
    assert sentencepiece_codec.encode(odd_documents.limit(0), PIECES).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [5, None, -1, 10**6]), (3, [])], "doc_id long, token_ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(bad, PIECES).collect()}[1] is None


@pytest.mark.parametrize("long_word", [2, 64])
def test_viterbi_on_noise(monkeypatch, long_word):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_codec, "LONG_WORD", long_word)
    sp, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.Codec(PIECES)
    for s in noise(long_word, 500, [*"ab 'st\n\t l1é　\x1c日!\rﬁ▁ ", "the", "ing", " " * 17, "https://www"]):
        assert c.encode([s])[0].tolist() == sp.encode(s), repr(s)


def test_license_base_counts(spark, documents_pd, odd_documents):
    def base(t):
        w = words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower=True)
        places = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))

    rng = random.Random(0)
    vocabulary = "cc by all rights reserved general public license gnu version 3 zz licensed under".split()
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.BASE)
    for t in [*documents_pd.text, *(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(800)), "ALL-RIGHTS\x00Reserved", "allé rights reserved", ""]:
        assert scanner.scan(t.encode())[:5] == base(t), t[:80]
    rows = license_scan.license_scan(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(r["labels"] == "" and r["score"] == 0 for r in rows)
    assert license_scan.license_scan(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("x Released under the MIT License. y", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("All rights reserved.", "reserved"), ("the license of the software", ""), ("released the under license mit", ""),
        ("Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files, to deal in the Software", "mit"),
    ],
)
def test_license_labels(text, labels):
    assert license_scan.Scanner(license_scan.TEMPLATES, license_scan.BASE).scan(text.encode())[5] == labels


def test_matching_statistics_against_brute_force():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.BASE)
    grams = {tuple(t[i:j]) for t in scanner.templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = random.Random(5)
    import numpy as np

    for _ in range(60):
        ids = [rng.choice([-1, *t[:6]]) if rng.random() < 0.3 else t[k] for t in [rng.choice(scanner.templates)] for k in range(rng.randrange(1, len(t)))]
        longest = [max((e - s for s in range(e) if tuple(ids[s:e]) in grams), default=0) for e in range(1, len(ids) + 1)]
        expected = {(e - n, e) for e, n in enumerate(longest, 1) if n >= scanner.long and (e == len(ids) or longest[e] <= n)}
        assert {(s, e) for s, e, _ in scanner.statistics(np.array(ids))[1]} == expected


def test_language_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text")
    rows = language_id.op1_language_id(spark, data).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and re.search(r"[^\W\d_]", r["text"] or "")]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_trigrams(text):
    low = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return [low[i - 1 : i + 2] for i in range(1, len(low) - 1) if low[i] != " "]


def test_filters_grow_with_their_ngrams():
    import numpy as np

    rng = np.random.default_rng(1)
    grams = {"a": rng.integers(0, 1 << 63, 200_000).astype(np.uint64), "b": rng.integers(0, 1 << 63, 300).astype(np.uint64)}
    filters = language_id.Filters(grams)
    assert filters.slots >= 8 * 200_000 and filters.slots & (filters.slots - 1) == 0 and filters.false.max() < 0.05
    for b, language in enumerate(filters.languages):
        assert (filters.masks(grams[language])[b // 64] >> np.uint64(b) & np.uint64(1)).all()


def test_languages_against_brute_force(spark):
    """Sets of strings instead of filters, loops instead of numpy; the filters' corrected counts come close to the true ones."""
    from collections import Counter

    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    held_out = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    counts = {}
    for r in rows:
        if not held_out[r["doc_id"]] and r["lang"] is not None and r["text"] is not None:
            counts.setdefault(r["lang"], Counter()).update(plain_trigrams(r["text"]))
    share = {}
    for lang, c in counts.items():
        share[lang] = {g: n / c.total() for g, n in c.items()}
    top = Counter()
    for c in share.values():
        for g, p in c.items():
            top[g] = max(top[g], p)
    sets = {lang: {g for g, p in c.items() if p >= language_id.SELDOM * top[g]} for lang, c in share.items()}
    mine = {r["doc_id"]: r for r in language_id.op1_language_id(spark, DATA).collect()}
    assert len(mine) == len(rows)
    for r in rows:
        grams = plain_trigrams(r["text"] or "")
        hits = {lang: sum(g in s for g in grams) for lang, s in sets.items()}
        got = mine[r["doc_id"]]
        assert got["held_out"] == held_out[r["doc_id"]]
        if not grams:
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        best = max(sorted(hits), key=hits.get)
        if sorted(hits.values())[-2:] != [hits[best]] * 2:
            assert got["lang_pred"] == best
        assert abs(got["score"] - hits[best] / sum(hits.values())) < 0.03


@pytest.mark.parametrize("most", [1, 2, 7, 100])
def test_slices_have_the_trigrams_of_the_text(most):
    import numpy as np

    texts = ["", "a", "ab cd, efg", "İstanbul İİ", "日本語のテキスト" * 9, "x1y2 z" * 30, "--"]
    whole, begins = language_id.trigrams(texts)
    found = [[] for _ in texts]
    for owner, grams, at in language_id.gram_lots(texts, most):
        for k, i in enumerate(owner):
            found[i] += grams[at[k] : at[k + 1]].tolist()
    assert found == [whole[begins[i] : begins[i + 1]].tolist() for i in range(len(texts))]
    assert isinstance(whole, np.ndarray)


def test_language_edges(spark, odd_documents):
    filters = language_id.fit(odd_documents.where("lang is not null"), "doc_id", "text", "lang")
    rows = {r["doc_id"]: r for r in language_id.predict(odd_documents, filters).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (3, 4, 5, 7)) and rows[1]["lang_pred"] == "en"
    nothing = language_id.fit(odd_documents.limit(0), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in language_id.predict(odd_documents, nothing).collect()} == {"und"}


def test_bloom_masks_hold_every_member():
    import numpy as np

    rng = np.random.default_rng(0)
    grams = {f"l{i:02d}": rng.integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64) for i in range(70)}
    f = language_id.Filters(grams)
    for b, name in enumerate(f.languages):
        assert ((f.masks(grams[name])[b // 64] >> np.uint64(b % 64)) & np.uint64(1)).all()
    strange = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64)
    counts, n = f.popcounts(strange, np.array([0, len(strange)]))
    assert counts.max() < 0.01 * n[0]


def test_full_texts_and_tables_of_templates(spark):
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.BASE)
    for label, text in license_scan.TEMPLATES:
        # a header before, other line breaks, and a word changed now and then
        edited = ["other" if i % 29 == 17 else w for i, w in enumerate(text.split())]
        found = scanner.scan(("Copyright 2024 the people of this file\n\n * " + "\n * ".join(" ".join(edited[i : i + 9]) for i in range(0, len(edited), 9)) + "\ncode follows").encode())
        assert label in found[5].split(","), label
    table = spark.createDataFrame([("own", "you may keep this file for as long as you like it"), ("own", None), (None, "x")], "label string, text string")
    own = license_scan.templates_of(table)
    docs = spark.createDataFrame([(1, "Well: you may keep this file for as long as you like it!"), (2, "nothing")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.license_scan(docs, own).collect()} == {1: "own", 2: ""}
    with pytest.raises(ValueError, match="at most"):
        license_scan.templates_of(table, most=10)


def test_repetitive_texts_take_time_in_proportion():
    import time

    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.BASE)
    took = []
    for n in (1000, 8000):
        text = b"Licensed under the Apache License, Version 2.0 zz yy xx ww vv uu tt\n" * n
        begun = time.perf_counter()
        assert len(scanner.scan(text)[7]) == n
        took.append(time.perf_counter() - begun)
    assert took[1] < 24 * took[0]


def test_state_maps_of_a_long_pretoken(monkeypatch):
    """A map gives for every entry state what a run from there gives, and composed maps the count of the whole."""
    from tokenizers import Tokenizer

    t, lib = token_counts.Transducer(BPE), Tokenizer.from_file(BPE)
    rng = random.Random(3)
    words_ = ["".join(rng.choice(["the", "token", "ization", "xq", "日本", "é"]) for _ in range(300)), "=" * 1001, "ab" * 700]
    for w in words_:
        raw = w.encode()
        states = [t.run(0, raw[:i])[0] for i in range(0, 90, 7)]
        for begin in (0, 100, 333):
            chunk = raw[begin : begin + 200]
            m = token_counts.StateMap(t, chunk)
            assert [m(s) for s in states] == [t.run(s, chunk) for s in states]
        for size in (5, 64, 300):
            monkeypatch.setattr(token_counts, "CHUNK", size)
            assert t.count_pretoken(w) == len(lib.encode(w, add_special_tokens=False).ids)


def test_long_words_go_through_the_lattice_in_stretches(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    c = sentencepiece_codec.Codec(PIECES)
    rng = random.Random(1)
    cjk = "".join(rng.choice("日本語の文章は空白を含まないことが多い。、今日天気良") for _ in range(5000))
    latin = "".join(rng.choice(["the", "token", "ization", "xq", "é", "12"]) for _ in range(2000))
    alone, calls = c.alone, []
    monkeypatch.setattr(c, "alone", lambda w: calls.append(w) or alone(w))
    texts = [cjk, latin, "ab" * 800, "x" * 700 + cjk[:600], *(cjk[:n] for n in (607, 608, 609, 1120, 1121)), latin[:63], latin[:64], latin[:65], "aé" * 400 + latin[:700]]
    assert [x.tolist() for x in c.encode(texts)] == [sp.encode(t) for t in texts]
    assert len(calls) <= 1
    runs = ["=" * 3000, "\n" * 1500 + "z"]
    assert [x.tolist() for x in c.encode(runs)] == [sp.encode(t) for t in runs]
    assert not any(len(w) > sentencepiece_codec.LONG_WORD for w in c.memo)


def test_other_models_are_refused():
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PIECES).serialized_model_proto()
    sentencepiece_codec.check_model(own)
    for trainer, normaliser in ((b"\x18\x01", b""), (b"", b""), (b"\x18\x02", b"\x12\x02ab\x18\x01\x20\x00"), (b"\x18\x02", b"\x18\x01\x20\x01"), (b"\x18\x02", b"\x18\x00\x20\x00")):
        with pytest.raises(ValueError, match="only models"):
            sentencepiece_codec.check_model(b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(normaliser)]) + normaliser)


def test_languages_of_no_rows_and_of_ties(spark):
    import numpy as np

    same = np.unique(language_id.trigrams(["abc abd"])[0])
    filters = language_id.Filters({"b": same, "a": same})
    docs = spark.createDataFrame([(1, "abc abd", "x"), (2, "zzz", "x"), (2, "zzz", "x")], "doc_id long, text string, score string")
    assert sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(docs, filters).collect()) == [(1, "a", 0.5), (2, "a", 0.0), (2, "a", 0.0)]
    assert language_id.predict(docs.limit(0), filters).count() == 0


def test_very_long_texts_in_every_text_operator(spark):
    """Two million characters, also without a space."""
    import sentencepiece
    from tokenizers import Tokenizer

    long_ = "the quick brown fox, number 12, licensed under the apache license, version 2.0; " * 26_000
    dense = "あいうえおかき" * 30_000
    docs = spark.createDataFrame([(1, long_), (2, dense)], "doc_id long, text string")
    lib, sp = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, BPE).collect()} == {k: len(lib.encode(t, add_special_tokens=False).ids) for k, t in ((1, long_), (2, dense))}
    assert {r["doc_id"]: r["n_tokens"] for r in sentencepiece_codec.encode(docs, PIECES).collect()} == {k: len(sp.encode(t)) for k, t in ((1, long_), (2, dense))}
    scanned = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert scanned[1]["labels"] == "apache-2.0" and len(scanned[1]["spans"]) == 26_000 and scanned[2]["n_words"] == 1
