"""The alignment's work by distinct words: words that repeat cost Spark no step of their own, and any list of words aligned ahead gives the same rows."""

import pytest
from test_alignment_and_middle import TEXTS, A, B, brute_alignment, noise

from graphloam.llm import token_align


@pytest.mark.parametrize("least", [0, 1 << 40])
def test_words_aligned_ahead_change_nothing(spark, monkeypatch, tmp_path, least):
    monkeypatch.setattr(token_align, "LEAST", least)
    monkeypatch.setattr(token_align, "SHARE", 1.0)
    monkeypatch.setattr(token_align, "LOT", 2000)
    rows = list(enumerate(TEXTS + noise(200, 3)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    ahead = token_align.often(docs, "text")
    assert (" cat" in ahead) == (least == 0)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in token_align.with_counts(token_align.align(docs, A, B)).collect()}
    assert got == brute_alignment(rows)


def test_a_lot_sends_each_word_once(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    (lot,) = token_align.tokenised(docs, A, B, []).collect()
    assert len(lot.docs) == 40 and all(len(d.words) == 301 and d.n_a == d.n_b == 301 for d in lot.docs)
    assert len(lot.at) == 6 and len(lot.ids) == 14 and len(lot.first) == 3  # five words, and the last one with its space; words of one shape share it


def test_forgotten_words_are_learnt_again(monkeypatch):
    monkeypatch.setattr(token_align, "MEMO", 4000)
    t = token_align.Both(A, B, [" the", " cat"])
    for text in [*TEXTS, *noise(60, 4)]:
        words, size = t.lot([text or ""])
        names = list(t.number)
        assert names[:2] == [" the", " cat"]
        if text and size[0]:
            assert "".join(names[i] for i in words.tolist()) == " " + text
        for side in range(2):
            raw = b"".join(t.sides[side].raw[i] for i in t.tokens(side, words).tolist())
            assert raw == (b" " + text.encode() if text and size[0] else b"")
        t.lots[words] += 1
