"""Licence scans: matching statistics against a generalised suffix automaton of licence templates.

The automaton holds every word sequence of the templates: whole public licence texts (files in ``licences``) and short notices.
A text streams through it once, which gives for each word the longest run ending there that some template holds, and the state
reached gives all places of that run in the templates. Maximal runs of at least three words are matches; matches of one template
that follow each other in text and template with small gaps are chained into a span, and a template whose chained words cover
enough of it, or of a run long enough to be telling, gives its label. Of the open chains of a template that end at the same place
of it one is kept (the longest), so their number is bounded by the template and time grows in proportion to the text.

Words are runs of characters outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z. Base labels come from fixed
phrases and always stay. Null counts as empty; a text without words has no labels, null places and score 0.
"""

from __future__ import annotations

import functools
import pkgutil
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from shelfmark.llm.common import arrow_map, once, texts

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Labels of the whole licence texts in the folder ``licences``.
WHOLE = ("apache-2.0", "bsd", "cc0", "gpl", "isc", "mit", "mpl-2.0")

#: Notices of public licences, by label.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "bsd": [
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ],
    "cc-by": [
        "licensed under cc by 4.0",
        "licensed under cc by nc 4.0",
        "licensed under cc by sa 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "reserved": ["copyright all rights reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"],
}

_SEPARATORS = bytes(32 if i <= 0x2F or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F else i for i in (c + 32 if 65 <= c <= 90 else c for c in range(256)))


def words_of(text: str) -> list[bytes]:
    # upper-case letters become lower-case before the separators are looked up, so A-Z aren't separators
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()


@functools.cache
def whole_texts() -> dict[str, list[str]]:
    """The whole licence texts by label, from the package's files."""
    return {label: [pkgutil.get_data(__package__, f"licences/{label}.txt").decode()] for label in WHOLE}


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        prefixes = []
        for t, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                prefixes.append((last, (t, at + 1)))
        self._number(prefixes)

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the strings that are one longer than p's longest."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _number(self, prefixes: list[tuple[int, tuple[int, int]]]) -> None:
        """Lays the prefixes' ends out so that those of all strings of a state (its subtree of links) are one slice."""
        own: list[list] = [[] for _ in self.next]
        below: list[list[int]] = [[] for _ in self.next]
        for state, end in prefixes:
            own[state].append(end)
        for state, up in enumerate(self.link):
            if up >= 0:
                below[up].append(state)
        self.ends: list[tuple[int, int]] = []
        self.slices = [slice(0)] * len(self.next)
        walk = [(0, -1)]
        while walk:
            state, first = walk.pop()
            if first < 0:
                walk.append((state, len(self.ends)))
                self.ends += own[state]
                walk += [(x, -1) for x in below[state]]
            else:
                self.slices[state] = slice(first, len(self.ends))

    def places(self, state: int) -> list[tuple[int, int]]:
        """All (template, end) of the strings that lead to a state."""
        return self.ends[self.slices[state]]

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """For each place, the length of the longest known run that ends there, and its state."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            out.append((n, state))
        return out


class LicenseScanner:
    def __init__(self, templates: dict[str, list[str]] | None = None, shortest: int = 5, gap: int = 6, cover: float = 0.6, telling: int = 12):
        self.shortest, self.gap, self.cover, self.telling = shortest, gap, cover, telling
        self.number: dict[bytes, int] = {}
        self.labels, sequences = [], []
        for given in (templates,) if templates else (TEMPLATES, whole_texts()):
            for label, line in ((label, line) for label, lines in given.items() for line in lines):
                self.labels.append(label)
                sequences.append([self.number.setdefault(w, len(self.number)) for w in words_of(line)])
        self.sequences = sequences
        self.phrases = [(tuple(words_of(p)), label) for p, label in PHRASES.items()]
        self.first = {p[0] for p, _ in self.phrases}
        self.automaton = SuffixAutomaton(sequences)
        sizes = [len(seq) for seq in sequences]
        self.need = [min(n, max(shortest, int(np.ceil(cover * n))), max(telling, shortest)) for n in sizes]

    def base(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str]]:
        """All places of the phrases: number, smallest and largest start, labels."""
        n, lo, hi, labels = 0, None, None, set()
        for p, label in self.phrases:
            if p[0] in words:
                at = -1
                while True:
                    try:
                        at = words.index(p[0], at + 1)
                    except ValueError:
                        break
                    if tuple(words[at : at + len(p)]) == p:
                        n += 1
                        lo, hi = at if lo is None else min(lo, at), at if hi is None else max(hi, at)
                        labels.add(label)
        return n, lo, hi, labels

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """Maximal runs (template, start in the template, start in the text, length) in text order."""
        number = self.number
        ids = [number.get(w, -1) for w in words]
        known = np.flatnonzero(np.array(ids) >= 0)
        if len(known) < 3:
            return
        for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):
            if len(run) < 3:
                continue
            a, b = int(run[0]), int(run[-1]) + 1
            stats = self.automaton.statistics(ids[a:b])
            for i, (n, state) in enumerate(stats):
                if n >= 3 and (i + 1 == len(stats) or stats[i + 1][0] <= n):  # can't be longer with the next word
                    for t, end in self.automaton.places(state):
                        yield t, end - n, a + i + 1 - n, n

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Covered template spans: (template, first word, end word, matched words)."""
        out: list[tuple[int, int, int, int]] = []
        open_: dict[int, dict[int, list[int]]] = {}  # template, its end: [text start, text end, matched]

        def close(t: int, c: list[int]) -> None:
            if c[2] >= self.need[t]:
                out.append((t, *c))

        for t, at, start, n in self.matches(words):
            chains, best = open_.setdefault(t, {}), None
            for end in range(at - self.gap, min(at + 2, at + n) + 1):
                c = chains.get(end)
                if c and -2 <= start - c[1] <= self.gap and (best is None or c[2] > chains[best][2]):
                    best = end
            c = chains.pop(best) if best is not None else [start, start, 0]
            c[1], c[2] = start + n, c[2] + start + n - max(c[1], start)
            old = chains.get(at + n)
            if old and start - old[1] <= self.gap and old[2] > c[2]:
                old, c = c, old  # the longer of two open chains goes on
            if old:
                close(t, old)
            chains[at + n] = c
        for t, chains in open_.items():
            for c in chains.values():
                close(t, c)
        return out

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score and spans."""
        words = words_of(text)
        n, lo, hi, base = self.base(words)
        spans = self.spans(words)
        labels = base | {self.labels[t] for t, *_ in spans}
        best = max((m / len(self.sequences[t]) for t, _, _, m in spans), default=0.0)
        score = min(1.0, max(best, 0.5 if n else 0.0))
        shown = sorted({(a, b, self.labels[t]) for t, a, b, _ in spans})
        return len(words), n, lo, hi, ",".join(sorted(base)), ",".join(sorted(labels)), score, ",".join(f"{label}:{a}:{b}" for a, b, label in shown)


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row a row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label:start:end in
    words, end exclusive). The score is the share of the best covered template, 0.5 at least where a base phrase stands."""

    def start():
        scanner = LicenseScanner(templates) if templates else once(LicenseScanner)

        def f(doc_id, text):
            rows = [scanner.scan(t or "") for t in text]
            return [doc_id, *([x[i] for x in rows] for i in range(8))]

        return f

    return arrow_map(texts(docs), start, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
