"""Nulls, empty and long input, repeated rows and clashing names, where no other test has them."""

import public_tokenizers

from graphloam.llm import decontaminate, sentencepiece_codec

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_items_and_documents_of_all_kinds(spark):
    item = "which planet of the solar system has the most known moons in the year of this question"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "prefix " + item + " suffix"), (4, "prefix " + item + " suffix"), (5, "clean"), (5, "clean"), (None, item), (6, "w " * 100_000 + item), (7, "w " * 100_000)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, i int, t string").repartition(3)
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, " ... ")], "item_id long, text string")
    stay = decontaminate.without_contained(docs, items)
    assert stay.columns == docs.columns
    assert sorted((repr(r.doc_id), repr(r.text)[:8]) for r in stay.collect()) == sorted((repr(k), repr(t)[:8]) for k, t in rows if t is None or item not in t)
    assert decontaminate.without_contained(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.without_contained(docs.limit(0), items).count() == 0


def test_decoding_of_all_kinds(spark):
    texts = ["", "two words", "two words", "long " * 30_000, "日本 🙂"]
    encoded = sentencepiece_codec.encode(spark.createDataFrame([(None if i == 1 else 7, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string"), PIECES)
    back = sentencepiece_codec.decode(encoded, PIECES)
    assert sorted(r.text for r in back.collect()) == sorted(texts) and back.columns == ["doc_id", "text"]
    assert sorted(repr(r.doc_id) for r in back.collect()) == ["7", "7", "7", "7", "None"]
    odd = spark.createDataFrame([(1, None, "a"), (2, [], "a"), (3, [None, 10**6, -1], "a")], "doc_id long, token_ids array<int>, text string")
    assert [r.text for r in sentencepiece_codec.decode(odd, PIECES).orderBy("doc_id").collect()] == [None, "", ""]
    assert sentencepiece_codec.decode(odd.limit(0), PIECES).count() == 0
