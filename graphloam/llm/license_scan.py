"""License scans with a generalised suffix automaton.

The words of all licence templates and of the base phrases go into one suffix automaton. A document's words are streamed
through it, which gives the matching statistics: at each word, the longest run of words ending there that stands somewhere
in a template. Runs that cannot be extended are chained, template by template, into spans: the next run of a chain lies
further on in the document and in the template, with few words between. A template whose chain covers enough of it gives
its label. Base phrases are counted at every place from the same stream, as suffixes of the current match; templates that are
too short for a chain are found in the same way, as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.llm.common import documents, small_batches, spread, utf8

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices and short full texts of well-known public licences, and the label that each gives.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.""",
    ),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
        this software for any purpose, including commercial applications, and to alter it and redistribute it freely""",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
]
#: Bytes of the texts of a table of templates; the automaton that every worker builds takes some hundred times that.
TEMPLATE_BYTES = 4 << 20

#: Words of a match that may enter a chain, words between two matches of a chain, share of a template that gives its label.
LONG, GAP, COVER = 3, 4, 0.75

# A-Z in lower case; ASCII that is neither letter nor digit becomes a space; all else stays.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Automaton:
    """A generalised suffix automaton over word numbers."""

    def __init__(self, sequences: list[list[int]], phrases: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate([*sequences, *phrases]):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                if k < len(sequences):
                    self.ends[last].add((k, i + 1))
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]
        #: where each state's strings end in the templates: (template, end)
        self.ends = [sorted(e) for e in self.ends]
        at: dict[int, list[tuple[int, int]]] = {}
        for p, seq in enumerate(phrases):
            v = 0
            for w in seq:
                v = self.next[v][w]
            at.setdefault(v, []).append((len(seq), p))
        #: phrases that end here, with their lengths, for the state's own strings and all shorter suffixes
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for v in sorted(range(1, len(self.link)), key=lambda v: self.length[v]):
            self.phrases[v] = at.get(v, []) + self.phrases[max(0, self.link[v])]

    def _new(self, length: int, link: int, arrows: dict[int, int]) -> int:
        self.next.append(arrows)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: int) -> int:
        """The state for exactly p's longest string and w."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        v = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = v
            p = self.link[p]
        if p >= 0:
            self.link[v] = self._split(p, w)
        return v


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], base: dict[str, str], long: int = LONG, gap: int = GAP, cover: float = COVER) -> None:
        self.long, self.gap, self.cover = long, gap, cover
        self.labels = [label for label, _ in templates]
        self.base_labels = list(base.values())
        self.number: dict[bytes, int] = {}
        number = lambda text: [self.number.setdefault(w, len(self.number)) for w in words_of(text.encode())]
        self.templates = [number(t) for _, t in templates]
        self.short = [k for k, t in enumerate(self.templates) if 0 < len(t) < long]
        whole = [number(p) for p in base] + [self.templates[k] for k in self.short]
        self.automaton = Automaton(self.templates, whole)
        #: words of the shortest run that can hold anything
        self.least = min([long, *(len(p) for p in whole if p)])

    def statistics(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(place, phrase) of every base phrase and, numbered after them, short template, and (first word, end, state) of every match that cannot be extended."""
        a, places, matches = self.automaton, [], []
        known = ids >= 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        begins, ends = edge[0::2], edge[1::2]
        for s, e in zip(begins[ends - begins >= self.least].tolist(), ends[ends - begins >= self.least].tolist(), strict=True):
            state = length = 0
            for i, w in enumerate(ids[s:e].tolist(), s):
                if w not in a.next[state]:
                    if length >= self.long:
                        matches.append((i - length, i, state))
                    while state and w not in a.next[state]:
                        state = a.link[state]
                        length = a.length[state]
                if w in a.next[state]:
                    state, length = a.next[state][w], length + 1
                    for n, p in a.phrases[state]:
                        if n <= length:
                            places.append((i + 1 - n, p))
            if length >= self.long:
                matches.append((e - length, e, state))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, share of the template that the chain covers) of all chains, the best first.

        A chain's matches follow each other in document and template with at most `gap` words between; overlaps in either
        count once. Of several chains that a match could follow it takes the one that covers most, of these the oldest. Matches
        come in the order of the text, so a chain that ended more than `gap` words before can't go on, and is not looked at
        again.
        """
        live: dict[int, list[list[int]]] = {}
        out: list[tuple[int, int, int, float]] = []

        def finish(k: int, c: list[int]) -> None:
            out.append((k, c[0], c[1], min(1.0, c[3] / len(self.templates[k]))))

        for s, e, state in matches:
            for k, end in self.automaton.ends[state]:
                begin, n = end - (e - s), e - s
                best, going = None, []
                for c in live.get(k, []):  # [first word, end, end in the template, words covered]
                    if s - c[1] > self.gap:
                        finish(k, c)
                        continue
                    going.append(c)
                    new = min(n, end - max(begin, c[2]), e - max(s, c[1]))
                    if new > 0 and -n < s - c[1] and -n < begin - c[2] <= self.gap and (best is None or c[3] > best[0][3]):
                        best = c, new
                if best:
                    c, new = best
                    c[1], c[2], c[3] = e, end, c[3] + new
                else:
                    going.append([s, e, end, n])
                live[k] = going
        for k, cs in live.items():
            for c in cs:
                finish(k, c)
        return sorted(out, key=lambda x: (-x[3], x[0], x[1]))

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        places, matches = self.statistics(ids) if len(ids) >= self.least else ([], [])
        spans = [x for x in self.spans(matches) if x[3] >= self.cover] if matches else []
        n = len(self.base_labels)
        if self.short and any(p >= n for _, p in places):
            short = [(k, i, i + len(self.templates[k]), 1.0) for i, p in places if p >= n for k in [self.short[p - n]]]
            spans = sorted([*spans, *short], key=lambda x: (-x[3], x[0], x[1]))
            places = [x for x in places if x[1] < n]
        base = {self.base_labels[p] for _, p in places}
        starts = [p for p, _ in places]
        labels = base | {self.labels[k] for k, *_ in spans}
        return (
            len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            1.0 if base else max((x[3] for x in spans), default=0.0), [{"label": self.labels[k], "first": s, "end": e, "cover": c} for k, s, e, c in spans],
        )


_SPANS = "array<struct<label:string,first:long,end:long,cover:double>>"
_scanners: dict[str, Scanner] = {}


def templates_of(table: DataFrame, label: str = "label", text: str = "text", most: int = TEMPLATE_BYTES) -> list[tuple[str, str]]:
    """The templates of a table; raises if their texts are larger than `most`. Rows without label or text are left out."""
    rows = table.select(F.col(label).cast("string").alias("l"), F.col(text).cast("string").alias("t")).dropna().distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    if size > most:
        raise ValueError(f"templates of {size} bytes; {most} at most")
    return sorted((r["l"], r["t"]) for r in rows.collect())


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row, without a shuffle.

    score: 1 with a base phrase, else the largest share of a template that a chain covers, 0 without one. Null and empty
    texts have no words, no places (first_word and last_word are null) and empty labels. Keys may repeat or be null. Very long
    texts are streamed whole, in time in proportion to their length. Ties between chains: see Scanner.spans(). Other columns,
    of whatever name, are not read; an empty table gives no rows. templates: see templates_of() for those of a table.
    """
    ident = repr((templates, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ident not in _scanners:
            _scanners[ident] = Scanner(templates, base)
        scanner = _scanners[ident]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))]
        for batch in batches:
            columns = list(zip(*map(scanner.scan, utf8(batch.column(1))), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {_SPANS}")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of documents; see license_scan()."""
    return license_scan(documents(spark, sf_dir)).drop("spans")
