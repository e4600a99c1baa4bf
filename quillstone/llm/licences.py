"""License scans (operator 1): matching statistics of a generalised suffix automaton, chained into template spans.

The automaton holds the token sequences of all licence templates. A text is streamed through it word by word, which
gives for every word the length of the longest match that ends there (the matching statistics). Maximal matches of
MIN_MATCH words or more are seeds; for each template they are chained in order of both sides, with gaps of at most
GAP words, into spans, whose coverage is the share of the template's words that the chain matches. A span that covers
COVER of its template gives the text the template's label. The base phrases are templates of their own: a phrase
stands wherever the automaton is in a state whose suffixes include it.

Words are runs of non-ASCII characters, digits and letters, with A-Z lower-cased. The automaton's size is bounded by
the templates; a text's stretches without template words cost one look-up a word.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows are scanned each by itself;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import slices

BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Opening clauses of public licence texts, in the words of this operator.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
)
MIN_MATCH = 3
GAP = 6
COVER = 0.7

_FOLD = bytearray(b" " * 256)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32
_FOLD = bytes(_FOLD)


def words_of_text(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Span:
    label: str
    template: int
    first: int  # words of the text, both included
    last: int
    coverage: float


class LicenceAutomaton:
    """Generalised suffix automaton over the templates' words."""

    def __init__(self, templates=TEMPLATES, base=BASE, min_match: int = MIN_MATCH, gap: int = GAP, cover: float = COVER):
        self.min_match, self.gap, self.cover, self.base = min_match, gap, cover, tuple(base)
        self.labels = [label for label, _ in templates]
        self.texts = [words_of_text(t) for _, t in templates]
        phrases = [words_of_text(p) for p, _ in base]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]  # (template, end) of the prefixes that the state holds
        for number, words in enumerate([*self.texts, *phrases]):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)), ends)
                ends[last].append((number, at + 1))
        # places of a state's words: its own and those of the states that have it as a suffix
        places = [set(e) for e in ends]
        for state in sorted(range(len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                places[self.link[state]] |= places[state]
        self.places = [sorted((t, e) for t, e in p if t < len(self.texts)) for p in places]
        whole = {self._state(p): (len(p), k) for k, p in enumerate(phrases)}
        self.phrases: list[tuple[tuple[int, int], ...]] = []
        for state in range(len(self.link)):
            found, s = [], state
            while s > 0:
                if s in whole:
                    found.append(whole[s])
                s = self.link[s]
            self.phrases.append(tuple(found))
        self.shortest = min([min_match, *map(len, phrases)])

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word, ends)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        ends.append([])
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word, ends)
        return new

    def _clone(self, p: int, q: int, word: int, ends: list) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        ends.append([])
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def _state(self, words: list[bytes]) -> int:
        s = 0
        for w in words:
            s = self.next[s][self.ids[w]]
        return s

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[Span]]:
        """((first word, phrase) of every base place, spans of templates)."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([False], ids >= 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        long = edge[1::2] - edge[::2] >= self.shortest
        base: list[tuple[int, int]] = []
        seeds: list[tuple[int, int, int]] = []  # end in the text, length, state
        for first, stop in zip(edge[::2][long].tolist(), edge[1::2][long].tolist(), strict=True):
            state, n = 0, 0
            for at, word in enumerate(ids[first:stop].tolist(), first):
                before = (at, n, state)
                while state and word not in self.next[state]:
                    state = self.link[state]
                    n = self.length[state]
                to = self.next[state].get(word)
                if to is None:
                    state, n = 0, 0
                else:
                    state, n = to, n + 1
                if before[1] >= self.min_match and n <= before[1]:
                    seeds.append(before)
                for size, k in self.phrases[state]:
                    if size <= n:
                        base.append((at + 1 - size, k))
            if n >= self.min_match:
                seeds.append((stop, n, state))
        return base, self._chain(seeds)

    def _chain(self, seeds: list[tuple[int, int, int]]) -> list[Span]:
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, state in seeds:
            for template, at in self.places[state]:
                by.setdefault(template, []).append((end - n, at - n, n))
        spans = []
        for template, found in sorted(by.items()):
            found.sort()
            total = len(self.texts[template])
            best: list[tuple[int, int, int, int]] = []  # covered words, first word, end in the text, end in the template
            for start, at, n in found:
                covered, first = n, start
                for c, f, end, t_end in reversed(best):
                    if start - end > self.gap + n:
                        break
                    # overlaps of consecutive matches count once
                    over = max(0, end - start, t_end - at)
                    if start - end <= self.gap and over < n and at - t_end <= self.gap and c + n - over > covered:
                        covered, first = c + n - over, f
                best.append((covered, first, start + n, at + n))
            top: dict[int, tuple[int, int]] = {}
            for c, f, end, _ in best:
                top[f] = max(top.get(f, (0, 0)), (c, end))
            spans += [Span(self.labels[template], template, f, end - 1, min(1.0, c / total)) for f, (c, end) in sorted(top.items()) if c >= self.cover * total]
        return spans


def scan_licences(docs: DataFrame, automaton: LicenceAutomaton | None = None) -> DataFrame:
    """Base counts, labels, score and spans of every row."""
    automaton = automaton or LicenceAutomaton()
    names = [label for _, label in automaton.base]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text in batch.column(1).to_pylist():
                    words = words_of_text(text)
                    base, spans = automaton.scan(words)
                    starts = [s for s, _ in base]
                    plain = {names[k] for _, k in base}
                    labels = plain | {s.label for s in spans}
                    score = 1.0 if plain else max((s.coverage for s in spans), default=0.0)
                    found = [{"label": s.label, "first": s.first, "last": s.last, "coverage": s.coverage} for s in spans]
                    rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(plain)), ",".join(sorted(labels)), score, found))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    out = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, coverage: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, out)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
