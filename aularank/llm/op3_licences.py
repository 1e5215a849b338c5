"""License scans by a generalised suffix automaton of licence words.

The automaton holds every template and phrase.  A text's words stream through it; the matching statistics (longest
run of words ending here that some template holds) give phrase places and long matches, and long matches with one
template are chained, in order, into the span of it that the text covers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aularank.llm.common import slices, utf8
from aularank.llm.op8_decontaminate import _FOLD

#: Phrases whose every place counts, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Wording of public licences and their notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
            "or substantial portions of the Software."),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
            "version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
            "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
            "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-nc", "Licensed under CC BY-NC 4.0"),
)


@dataclass(frozen=True)
class LicenceParams:
    """``least``: words of a long match; ``gap``: text words between chained matches; ``cover``: share of a template that gives its label."""

    least: int = 4
    gap: int = 16
    cover: float = 0.75


def words_of(data: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return data.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers; states know where in which templates they end."""

    def __init__(self, phrases: tuple, templates: tuple):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]  # template -> all end positions
        number = lambda text: [self.ids.setdefault(w, len(self.ids)) for w in words_of(text.encode())]
        self.templates = [(label, number(text)) for label, text in templates]
        self.phrases = [(label, number(text)) for text, label in phrases]
        for _, run in self.phrases:
            self._add(run, -1)
        for at, (_, run) in enumerate(self.templates):
            self._add(run, at)
        order = sorted(range(1, len(self.size)), key=lambda s: -self.size[s])
        for s in order:  # a state's suffix ends wherever the state does
            up = self.ends[self.link[s]]
            for t, ends in self.ends[s].items():
                if self.link[s] > 0:
                    up.setdefault(t, set()).update(ends)
        phrase_state: dict[int, list[tuple[int, str]]] = {}
        for label, run in self.phrases:
            s = 0
            for w in run:
                s = self.next[s][w]
            phrase_state.setdefault(s, []).append((len(run), label))
        self.closes: list[list[tuple[int, str]]] = [[] for _ in self.size]
        for s in reversed(order):
            self.closes[s] = self.closes[self.link[s]] + phrase_state.get(s, [])

    def _state(self, size: int, next_: dict[int, int], link: int, ends: dict[int, set[int]]) -> int:
        self.size.append(size)
        self.next.append(next_)
        self.link.append(link)
        self.ends.append(ends)
        return len(self.size) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of q for its shorter suffixes, those that follow p by w."""
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q], {})
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _add(self, run: list[int], template: int) -> None:
        last = 0
        for at, w in enumerate(run):
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, q, w)
            else:
                new = self._state(self.size[last] + 1, {}, 0, {})
                p = last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
                last = new
            if template >= 0:
                self.ends[last].setdefault(template, set()).add(at)


@dataclass(frozen=True)
class Span:
    """A chain: first and last word of the text, first and last word of the template, covered share of the template."""

    template: int
    first_word: int
    last_word: int
    from_word: int
    to_word: int
    cover: float


@dataclass
class Found:
    """Phrase places (start word, label), all chains by their place, and the best covered share of each template."""

    n_words: int
    places: list[tuple[int, str]]
    cover: dict[int, float]
    spans: list[Span]


def scan(data: bytes, a: Automaton, p: LicenceParams) -> Found:
    """Matching statistics of a whole text, and its chains."""
    words = words_of(data)
    numbers = list(map(a.ids.get, words))
    places: list[tuple[int, str]] = []
    matches: list[tuple[int, int, int]] = []  # (first word, words, state)
    s = size = 0
    link, nexts, sizes, closes, least = a.link, a.next, a.size, a.closes, p.least
    for i, w in enumerate(numbers):
        if w is None:
            if size >= least:
                matches.append((i - size, size, s))
            s = size = 0
            continue
        go = nexts[s].get(w)
        if go is None:
            if size >= least:
                matches.append((i - size, size, s))
            while go is None and s > 0:
                s = link[s]
                size = sizes[s]
                go = nexts[s].get(w)
            if go is None:  # not even alone: cannot be, as every numbered word is in a template
                s = size = 0
                continue
        s, size = go, size + 1
        for k, label in closes[s]:
            if k <= size:
                places.append((i - k + 1, label))
    if size >= least:
        matches.append((len(words) - size, size, s))
    spans = _chains(matches, a, p) if matches else []
    best: dict[int, float] = {}
    for x in spans:
        best[x.template] = max(best.get(x.template, 0.0), x.cover)
    return Found(len(words), places, best, spans)


def _chains(matches: list[tuple[int, int, int]], a: Automaton, p: LicenceParams) -> list[Span]:
    """Matches chained while the text gap is small and text and template go on, over all places in a template.

    Every pair of a match and a place in a template knows its best way there; then, from the best end back, chains are
    taken that share no text word with a chain of the same template taken before.
    """
    pairs: dict[int, list[tuple[int, int, int]]] = {}  # template -> (first word, template word, words), in text order
    for first, size, s in matches:
        for t, ends in a.ends[s].items():
            pairs.setdefault(t, []).extend((first, end - size + 1, size) for end in sorted(ends))
    spans = []
    for t, own in pairs.items():
        best, before, low = [], [], 0
        for i, (first, begin, size) in enumerate(own):
            while own[low][0] + own[low][2] < first - p.gap:  # ends go up with the matches
                low += 1
            covered, back = size, -1
            for j in range(low, i):
                first_j, begin_j, size_j = own[j]
                new = size - max(0, first_j + size_j - first, begin_j + size_j - begin)  # no word of either is used twice
                if new > 0 and first_j < first and begin_j < begin and best[j] + new >= covered:  # of equals, the nearest
                    covered, back = best[j] + new, j
            best.append(covered)
            before.append(back)
        starts: list[int] = []
        taken: list[tuple[int, int]] = []  # text words [first, after) of the chains taken, in order
        for i in sorted(range(len(own)), key=lambda k: (-best[k], k)):
            chain, k = [], i
            while k >= 0:
                first, _, size = own[k]
                at = bisect_left(starts, first + size)
                if at and taken[at - 1][1] > first:
                    break
                chain.append(k)
                k = before[k]
            if chain:
                first, begin, _ = own[chain[-1]]
                # the last match stands for all of its words where the way before it is another chain's
                covered = own[chain[-1]][2] + best[i] - best[chain[-1]]
                after, to = own[i][0] + own[i][2], own[i][1] + own[i][2]
                at = bisect_left(starts, first)
                starts.insert(at, first)
                taken.insert(at, (first, after))
                spans.append(Span(t, first, after - 1, begin, to - 1, covered / len(a.templates[t][1])))
    return sorted(spans, key=lambda x: (x.first_word, x.template))


_built: dict[tuple, Automaton] = {}


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, params: LicenceParams = LicenceParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row.

    n_base counts all phrase places; base_labels are their labels; labels has also those of templates covered to
    ``cover`` or more; score is the best cover, or 1 where a phrase stands.  Null and empty texts have no words: counts 0,
    null first and last word, empty labels, score 0, no spans.  spans are all chains by their place: label, template
    (its place in ``templates``), first and last word of the text, first and last word of the template, cover.  Long texts are scanned whole, repeated rows one by one; other
    columns are not read; an empty table gives an empty one.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
             pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), *((x, pa.int64()) for x in ("first_word", "last_word", "from_word", "to_word")), ("cover", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _built.get((phrases, templates)) or _built.setdefault((phrases, templates), Automaton(phrases, templates))
        for part in slices(batches, "text"):
            rows = []
            for data in utf8(part, "text"):
                f = scan(data, a, params)
                base = {label for _, label in f.places}
                own = {a.templates[t][0] for t, c in f.cover.items() if c >= params.cover}
                starts = [x for x, _ in f.places]
                rows.append((f.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)),
                             1.0 if base else max(f.cover.values(), default=0.0),
                             [{"label": a.templates[x.template][0], **vars(x)} for x in f.spans]))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:]))], names)

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                             "spans array<struct<label: string, template: int, first_word: long, last_word: long, from_word: long, to_word: long, cover: double>>")
