"""Cross-tokenizer alignment and fill-in-middle against plain Python."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest

from graphloam.llm import fill_in_middle, token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "  two  spaces ", "line\nbreaks\n\n \tand tabs\t ", "naïve café – 東京 🙂🙂 привет", "a▁mark", "<|endoftext|> and </s> <s>", "x" * 3000, "a b " * 4000, "don't we'll 12345 6.7e-8 !!'s",
    "the cat sat on the mat", "the cat sat on the mat", " nbsp em \x85 \x1c\x1d", "=" * 700 + " \n\n\n " + "=" * 50, "tail \n ", "\x00nul", "é combining",
]


def noise(n: int, seed: int) -> list[str]:
    rng, parts = random.Random(seed), ["the", " ", "  ", "\n", "\t", " cat", "dog's", "1234", "é", "東", "🙂", "!?", "<P>", "=", "ing", " ", " \n ", "Zx9qv"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(n)]


def brute_alignment(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    import sentencepiece
    import tokenizers

    a, b = token_align.ByteLevel(A).raw, token_align.Pieces(B).raw
    one, two = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    found, documents = {}, Counter()
    for key, text in rows:
        whole = b" " + (text or "").encode()
        x, y = one.encode(" " + (text or ""), add_special_tokens=False).ids, two.encode(text or "")
        if not text or b"".join(a[i] for i in x) != whole or b"".join(b[i] for i in y) != whole:
            found[key] = (0, 0, [], [])
            continue
        spans = []
        for ids, raw in ((x, a), (y, b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(raw[i]), i))
                at += len(raw[i])
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [tuple([i for s, e, i in own if lo <= s and e <= hi] for own in spans) for lo, hi in zip([0, *ends], ends, strict=False)]
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if max(s, t) < min(e, f)] if len(x) < 400 else None
        if links is None:  # the same by two pointers
            links, i, j = [], 0, 0
            while i < len(x) and j < len(y):
                links.append((x[i], y[j]))
                p, q = spans[0][i][1], spans[1][j][1]
                i, j = i + (p <= q), j + (q <= p)
        documents.update(set(links))
        found[key] = (len(x), len(y), groups, links)
    top: dict[int, int] = {}
    for (i, _), n in documents.items():
        top[i] = max(top.get(i, 0), n)
    out = {}
    for key, (n, m, groups, links) in found.items():
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out[key] = (n, m, len(groups), len(links), sum(documents[x] == top[x[0]] for x in links), sum(documents[x] for x in links), text)
    return out


@pytest.mark.parametrize("hot", [token_align.HOT, 40])
def test_alignment_against_two_pointers(spark, hot):
    rows = list(enumerate(TEXTS + noise(60, 1)))
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, a int, merged string").repartition(3)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in token_align.with_counts(token_align.align(docs, A, B), hot).collect()}
    assert got == brute_alignment(rows)


def test_alignment_of_other_keys_and_no_rows(spark):
    rows = spark.createDataFrame([("k", "the cat"), ("k", "the cat"), (None, "the cat"), (None, None)], "`my key` string, body string")
    out = token_align.with_counts(token_align.align(rows, A, B, key="my key", text="body")).collect()
    assert sorted((r["my key"] or "", r.n_a, r.count_sum) for r in out) == [("", 0, 0), ("", 2, 6), ("k", 2, 6), ("k", 2, 6)]
    assert token_align.with_counts(token_align.align(rows.limit(0), A, B, key="my key", text="body")).count() == 0


def brute_middle(key, text: str | None) -> tuple:
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middle_against_plain_python(spark):
    rows = [*enumerate(TEXTS + noise(300, 2) + ["<P", "S> <M", "a <S> b", "x <", ">P>"]), (None, "no key at all here"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, output string").repartition(3)
    out = fill_in_middle.fill_in_middle(docs, columns=("n", "form", "prefix_chars", "middle_chars", "output", "restored", "output_sha256", "restored_sha256")).collect()
    want = sorted((repr(k), *map(repr, brute_middle(k, t)), repr(t or "")) for k, t in rows)
    assert sorted((repr(r.doc_id), *map(repr, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), repr(r.restored)) for r in out) == want
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest() for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_middle_of_an_empty_table_and_other_keys(spark):
    docs = spark.createDataFrame([("k", "some words here")], "`my key` string, text string")
    assert fill_in_middle.fill_in_middle(docs.limit(0), key="my key").count() == 0
    r = fill_in_middle.fill_in_middle(docs, key="my key").first()
    assert (r["my key"], r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == ("k", *brute_middle("k", "some words here"))
