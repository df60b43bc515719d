"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every template and every base phrase, as words. A text streams through it word by
word; the length of the longest match that ends at each word (its matching statistic) gives

* the places of the base phrases: the phrase is a suffix of the match, that is, its state is the
  current one or a suffix-link ancestor of it;
* long matches: statistics that stop growing at ``MIN_MATCH`` words or more. Each lies in one or more
  templates; matches that follow one another in text and template within ``MAX_GAP`` words are chained
  into spans, and a template of which ``MIN_COVER`` of the words are covered gives its label.

The automaton's size is that of the templates, a constant; it goes to the executors with the code.
Words that no template has cannot be matched, so that only runs of known words are streamed.

Defined cases: a null or empty text has no words, null first_word and last_word, empty labels and
score 0. score: 1 with a base place, else the largest covered share of a template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import batch, read, utf8

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of well-known licences, in their published wording.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: A match shorter than this is chance; chained matches leave at most MAX_GAP words between them.
MIN_MATCH, MAX_GAP, MIN_COVER = 6, 12, 0.3

#: Bytes of words: ASCII letters (lower-cased) and digits, and all of non-ASCII; the rest separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """A generalised suffix automaton over word ids. ends[state]: the template positions (template,
    index of the last word) of the state's strings, filled up along suffix links from the leaves."""

    def __init__(self, texts: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(texts):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, own)
                own[last].append((t, i))
        order = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        ends = [set(x) for x in own]
        for s in order:
            ends[self.link[s]] |= ends[s]
        self.ends = [sorted(x) for x in ends]

    def _new(self, own: list, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        own.append([])
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int, own: list) -> int:
        clone = self._new(own, self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, own: list) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q, own)
        new = self._new(own, self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q, own)
        return new


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> None:
        templates = TEMPLATES if templates is None else templates
        phrases = PHRASES if phrases is None else phrases
        self.labels = list(templates)
        texts = [words_of(t.encode()) for t in templates.values()]
        base = [words_of(p.encode()) for p in phrases]
        self.vocab: dict[bytes, int] = {}
        for words in (*texts, *base):
            for w in words:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.sizes = [len(t) for t in texts]
        self.sam = Automaton([[self.vocab[w] for w in words] for words in (*texts, *base)])
        self.shortest = min([*map(len, base), MIN_MATCH])
        # of each state, the base phrases that are suffixes of its longest string
        self.phrase_at: list[list[tuple[int, str]]] = [[] for _ in self.sam.link]
        states = {}
        for words, label in zip(base, phrases.values(), strict=True):
            s = 0
            for w in words:
                s = self.sam.next[s][self.vocab[w]]
            states.setdefault(s, []).append((len(words), label))
        for s in range(len(self.sam.link)):
            a = s
            while a > 0:
                self.phrase_at[s] += states.get(a, ())
                a = self.sam.link[a]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]], dict[str, float]]:
        """Number of words; base places (start, label); spans (first word, after the last, label); covered shares by label."""
        words = words_of(text)
        n = len(words)
        get = self.vocab.get
        ids = np.fromiter([get(w, 0) for w in words], np.int32, n)
        known = np.flatnonzero(ids)
        if len(known) < self.shortest:
            return n, [], [], {}
        cut = np.flatnonzero(np.diff(known) != 1) + 1
        starts, stops = np.r_[0, cut], np.r_[cut, len(known)]
        long = np.flatnonzero(stops - starts >= self.shortest)
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []  # text position after the match, length, state
        following, link, length, phrase_at = self.sam.next, self.sam.link, self.sam.length, self.phrase_at
        for first, after in zip(known[starts[long]].tolist(), (known[stops[long] - 1] + 1).tolist(), strict=True):
            state = size = 0
            for i, w in enumerate(ids[first:after].tolist(), first):
                if w in following[state]:
                    state, size = following[state][w], size + 1
                else:
                    if size >= MIN_MATCH:
                        matches.append((i, size, state))
                    while state and w not in following[state]:
                        state = link[state]
                    size = length[state]
                    if w in following[state]:
                        state, size = following[state][w], size + 1
                if phrase_at[state]:
                    for m, label in phrase_at[state]:
                        if m <= size:
                            places.append((i + 1 - m, label))
            if size >= MIN_MATCH:
                matches.append((after, size, state))
        return n, places, *(self.chain(matches) if matches else ([], {}))

    def chain(self, matches: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, str]], dict[str, float]]:
        """Chains of long matches, in order in text and template, and the share of each template they cover."""
        chains: dict[int, list[list]] = {}
        within_reach: dict[int, list[list]] = {}  # chains that a match may still go on
        for after, size, state in matches:
            for t, last in self.sam.ends[state]:
                if t >= len(self.sizes):
                    continue
                begin, end = last + 1 - size, last + 1
                near = within_reach[t] = [c for c in within_reach.get(t, ()) if after - size - c[1] <= MAX_GAP]
                for c in reversed(near):
                    if abs(begin - c[2]) <= MAX_GAP and end > c[2]:
                        c[3] += end - max(begin, c[2])
                        c[1], c[2] = after, end
                        break
                else:
                    near.append([after - size, after, end, size])
                    chains.setdefault(t, []).append(near[-1])
        spans, cover = [], {}
        for t, found in chains.items():
            share = max(c[3] for c in found) / self.sizes[t]
            label = self.labels[t]
            cover[label] = max(cover.get(label, 0.0), min(1.0, share))
            spans += [(c[0], c[1], label) for c in found if c[3] >= MIN_COVER * self.sizes[t]]
        return sorted(spans), cover


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """One row for each row of ``df``: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score;
    with ``spans`` also the covered template spans."""
    more = [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType()), T.StructField("label", T.StringType())])))] if spans else []
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")), *(T.StructField(c, T.StringType()) for c in ("base_labels", "labels")), T.StructField("score", T.DoubleType()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for rows in batches:
            out = []
            for t in utf8(rows.column(1)):
                n, places, found, cover = scan(t)
                base = sorted({label for _, label in places})
                labels = sorted({*base, *(label for *_, label in found)})
                at = [p for p, _ in places]
                row = (n, len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), 1.0 if at else max(cover.values(), default=0.0))
                out.append((*row, [dict(zip(("first", "after", "label"), s, strict=True)) for s in found]) if spans else row)
            yield batch(schema, [rows.column(0), *([r[i] for r in out] for i in range(len(schema) - 1))])

    return df.select(key, text).mapInArrow(run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))
