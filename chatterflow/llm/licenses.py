"""License scan: matching statistics from a generalised suffix automaton of licence words, chained into template spans.

The automaton over the words of all templates and phrases is built once on the driver (at most two states for each of their
words; the templates are the caller's parameter) and goes to the tasks with the code. Files are streamed in Arrow batches:
words become numbers by their hashes, and wherever two neighbouring words stand together in some template the automaton runs
and tells, for every word, the longest stretch ending there that occurs in a template. Elsewhere this statistic is at most 1,
so skipping loses nothing. A phrase is found where its own state lies on the suffix links of the current one. A match that
the next word doesn't lengthen is maximal; maximal matches of ``MIN_MATCH`` words or more are chained for each template in the
order of both sides, across at most ``MAX_GAP`` words of text, and a chain that covers ``MIN_SHARE`` of its template is a span.
Nothing is shuffled; a text is one row's work, in time linear in its words times ``MAX_GAP``.

Defined results: a null text counts as empty, and an empty one has no words, no places, no spans and a score of 0. Repeated
rows are scanned alike, null ids too. Of chains that cover alike the one that ends first is taken; spans of one template
don't overlap. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _FOLD, chunks, hash_runs, text_bytes, with_text

# The phrases of the contract, by label.
PHRASES = {"gpl": ("gnu general public license",), "apache": ("apache license",), "cc-by": ("cc by",), "mit": ("mit license",)}

# Public licence texts and notices, by label.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall "
        "be included in all copies or substantial portions of the software",
        "released under the mit license",
    ),
    "apache": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under "
        "the license",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without "
        "even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 2 1 of the license or at your option any later version",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http "
        "mozilla org mpl 2 0",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in "
        "source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license",
        "licensed under cc by 4 0",
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
}

MIN_MATCH, MAX_GAP, MIN_SHARE = 4, 12, 0.75
PLACE = "array<struct<label: string, start: long>>"
SPAN = "array<struct<label: string, template: int, start: long, end: long, covered: int, share: double>>"

_INSIDE = np.zeros(256, bool)
_INSIDE[ord("0") : ord("9") + 1] = _INSIDE[ord("a") : ord("z") + 1] = _INSIDE[128:] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of lower-cased text, and the n + 1 word offsets of the documents."""
    inside = _INSIDE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    after_gap = np.ones(len(raw), bool)
    after_gap[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (after_gap | edge[:-1]))
    before_gap = np.ones(len(raw), bool)
    before_gap[:-1] = ~inside[1:]
    return starts, np.flatnonzero(inside & (before_gap | edge[1:])) + 1, np.searchsorted(starts, offsets)


def _split(text: str) -> list[str]:
    raw = _FOLD[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
    return [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers. Templates with their words, and what each state tells."""

    labels: list[str]
    lengths: list[int]
    phrases: int
    vocabulary: dict[str, int]
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    #: by state, the phrases whose words end here: (length, phrase), shortest first
    ends: list[tuple[tuple[int, int], ...]] = field(default_factory=list)
    #: by state, where its words end in templates: (template, end)
    spots: list[tuple[tuple[int, int], ...]] = field(default_factory=list)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.longest[q] == self.longest[last] + 1 else self._clone(last, c, q)
        new = self._state({}, self.longest[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, following: dict[int, int], longest: int, link: int) -> int:
        self.next.append(following)
        self.longest.append(longest)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.longest[p] + 1, self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new


def automaton(templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, tuple[str, ...]] = PHRASES) -> Automaton:
    """Phrases come first, then the templates, each as a string of its own."""
    texts = [(label, _split(t)) for group in (phrases, templates) for label, own in group.items() for t in own]
    n_phrases = sum(map(len, phrases.values()))
    vocabulary: dict[str, int] = {}
    for _, words in texts:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    a = Automaton([label for label, _ in texts], [len(words) for _, words in texts], n_phrases, vocabulary)
    for _, words in texts:
        state = 0
        for w in words:
            state = a._extend(state, vocabulary[w])
    # states of all prefixes, once the automaton is whole
    marks: list[list[tuple[int, int]]] = [[] for _ in a.next]
    finals: list[list[tuple[int, int]]] = [[] for _ in a.next]
    for t, (_, words) in enumerate(texts):
        state = 0
        for i, w in enumerate(words):
            state = a.next[state][vocabulary[w]]
            if t >= n_phrases:
                marks[state].append((t, i + 1))
        if t < n_phrases and words:
            finals[state].append((len(words), t))
    order = sorted(range(len(a.next)), key=a.longest.__getitem__)
    for s in reversed(order[1:]):  # what ends with a state's words ends with those of its link
        marks[a.link[s]] += marks[s]
    for s in order[1:]:
        finals[s] = finals[a.link[s]] + finals[s]
    a.spots = [tuple(sorted(set(m))) if s else () for s, m in enumerate(marks)]
    a.ends = [tuple(sorted(f)) for f in finals]
    return a


def statistics(a: Automaton, tokens: list[int]) -> list[tuple[int, int]]:
    """Matching statistics: for every word the state and length of the longest stretch ending there that a template has."""
    out, s, n = [], 0, 0
    nexts, link, longest = a.next, a.link, a.longest
    for c in tokens:
        while s and c not in nexts[s]:
            s = link[s]
            n = longest[s]
        if c in nexts[s]:
            s, n = nexts[s][c], n + 1
        out.append((s, n))
    return out


def chains(matches: list[tuple[int, int, int]], length: int, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_share: float = MIN_SHARE) -> list[tuple[int, int, int]]:
    """(start, end, covered) of a template's spans from its matches (end in the text, end in the template, words).

    The best chain that ends with each match, over the matches before it within the gap; then, as long as one covers enough, the
    chain that covers most. Matches that overlap in a chain count their new words only.
    """
    matches = sorted(matches)
    ends = [m[0] for m in matches]
    best: list[tuple[int, int]] = []  # covered, first word
    longest = max((m[2] for m in matches), default=0)
    for i, (x, y, n) in enumerate(matches):
        found = (n, x - n)
        for j in range(bisect.bisect_left(ends, x - longest - max_gap), i):
            u, v, _ = matches[j]
            new = min(n, x - u, y - v)
            if 0 < new and u < x and x - n - u <= max_gap and best[j][0] + new > found[0]:
                found = (best[j][0] + new, best[j][1])
        best.append(found)
    need = max(min(min_match, length), min_share * length)
    picked: list[tuple[int, int, int]] = []
    for covered, x, start in sorted((-c, ends[i], s) for i, (c, s) in enumerate(best) if c >= need):
        if _free(picked, start, x):
            bisect.insort(picked, (start, x, -covered))
    return picked


def _free(picked: list[tuple[int, int, int]], start: int, end: int) -> bool:
    """No span of the sorted, disjoint ones overlaps [start, end)."""
    i = bisect.bisect_left(picked, (end,))
    return i == 0 or picked[i - 1][1] <= start


class Scanner:
    """What a task needs: the automaton, its words by hash and its pairs of neighbouring words."""

    def __init__(self, a: Automaton, min_match: int, max_gap: int, min_share: float):
        self.a, self.rules = a, (min_match, max_gap, min_share)
        names = [w.encode() for w in a.vocabulary]
        raw = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(n) for n in names]) if names else np.empty(0, np.int64)
        hashes = hash_runs(raw, ends - [len(n) for n in names], ends) if names else np.empty(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.pairs = np.array(sorted(c * len(names) + d for c, s in a.next[0].items() for d in a.next[s]), np.int64)
        self.single = [t for t in range(a.phrases) if a.lengths[t] == 1]

    def tokens(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        if not len(self.hashes):
            return np.full(len(starts), -1, np.int64)
        own = hash_runs(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return np.where(self.hashes[at] == own, self.order[at], -1)

    def scan(self, tokens: np.ndarray) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, int, int, float]]]:
        """Places of phrases and spans of templates in one text."""
        a, (min_match, max_gap, min_share) = self.a, self.rules
        places: list[tuple[str, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        if self.single:  # a phrase of one word has no pair
            for t in self.single:
                word = next(w for w, s in a.next[0].items() if (1, t) in a.ends[s])
                places += [(a.labels[t], int(i)) for i in np.flatnonzero(tokens == word)]
        if len(tokens) > 1 and len(self.pairs):
            left, right = tokens[:-1], tokens[1:]
            code = np.where((left >= 0) & (right >= 0), left * len(a.vocabulary) + right, -1)
            known = self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code
            step = np.diff(np.concatenate(([False], known, [False])).astype(np.int8))
            for first, last in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                first, last = int(first), int(last)  # the words first..last stand in known pairs
                seen = statistics(a, tokens[first : last + 1].tolist())
                for i, (s, n) in enumerate(seen):
                    places += [(a.labels[t], first + i + 1 - size) for size, t in a.ends[s] if 1 < size <= n]
                    if n > 1 and (i + 1 == len(seen) or seen[i + 1][1] <= n):
                        for t, y in a.spots[s]:
                            if n >= min(min_match, a.lengths[t]):
                                matches.setdefault(t, []).append((first + i + 1, y, n))
        spans = []
        for t, own in matches.items():
            spans += [(a.labels[t], t - a.phrases, s, e, c, min(c / a.lengths[t], 1.0)) for s, e, c in chains(own, a.lengths[t], min_match, max_gap, min_share)]
        return sorted(places, key=lambda p: (p[1], p[0])), sorted(spans, key=lambda p: (p[2], p[3], p[1]))


def scan(
    docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, tuple[str, ...]] = PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_share: float = MIN_SHARE
) -> DataFrame:
    """doc_id, n_words, places (of phrases), spans (of templates) and score, the greatest share of a template or phrase found."""
    scanner = Scanner(automaton(templates, phrases), min_match, max_gap, min_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_bytes(b.column("text"))
            for lo, hi in chunks(offsets):
                part = _FOLD[raw[offsets[lo] : offsets[hi]]]
                starts, ends, of = word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
                numbers = scanner.tokens(part, starts, ends)
                found = [scanner.scan(numbers[of[i] : of[i + 1]]) for i in range(hi - lo)]
                places = [[{"label": x, "start": s} for x, s in p] for p, _ in found]
                names = ("label", "template", "start", "end", "covered", "share")
                spans = [[dict(zip(names, s, strict=True)) for s in own] for _, own in found]
                score = [1.0 if p else max((s[-1] for s in own), default=0.0) for p, own in found]
                data = [b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(of)), pa.array(places, _PLACES), pa.array(spans, _SPANS), pa.array(score, pa.float64())]
                yield pa.record_batch(data, ["doc_id", "n_words", "places", "spans", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_text(docs).mapInArrow(run, f"doc_id {kind}, n_words long, places {PLACE}, spans {SPAN}, score double")


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int32()), ("share", pa.float64())]))
