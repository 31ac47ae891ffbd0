"""Licence scanning with a generalised suffix automaton of licence tokens.

All passages and phrases are inserted in one automaton. A document's words are streamed through
it, which gives at each word the longest substring of any passage that ends there (matching
statistics). Maximal long matches are chained, passage by passage, into covered spans: the chain
of most covered words whose gaps are short, in the text and in the passage. A passage whose words
are covered enough gives the label of its licence. Phrases are found in the same pass: one ends
where the match is as long as the phrase and the state lies below the phrase's own.

Null and empty texts have no words and no labels. Every occurrence counts, overlapping ones too;
of chains that overlap in the text, of one passage or of several, the one that covers most words
is a span, the earlier of equal ones (equal chains at one place all are). Texts of any length are read whole. Repeated rows each give a row; an empty table gives
none. Columns of the table that have the names of the new ones are replaced by them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_text

# The phrases to find and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Passages of public licence texts, by label: the permissive licences' grants,
# conditions and warranty clauses, and the notices by which the longer licences are applied.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "bsd-2-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsd-3-clause": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "zlib": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "gpl-2": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    "gpl-3": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    ),
    "agpl-3": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
    "epl-2": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    ),
    "cc-by-nc": ("this work is licensed under the creative commons attribution noncommercial 4 0 international license",),
    "cc-by": ("this work is licensed under the creative commons attribution 4 0 international license",),
    "cc-by-sa": ("this work is licensed under the creative commons attribution sharealike 4 0 international license",),
}
#: Shortest match that takes part in a chain, words between chained matches, least share of a template.
LEAST_MATCH = 5
GAP = 12
LEAST_SHARE = 0.6
#: Words are runs of ASCII letters and digits and of bytes beyond ASCII; all else separates.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


@dataclass
class Automaton:
    """Suffix automaton over the token sequences of several texts."""

    vocab: dict[bytes, int]
    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    phrase: list[tuple[tuple[int, str], ...]]
    places: list[list[tuple[str, int]]]
    sizes: dict[str, int]

    @classmethod
    def build(cls, phrases: dict[str, str], templates: dict[str, tuple[str, ...]]) -> Automaton:
        self = cls({}, [{}], [-1], [0], [], [], {})
        marks: dict[int, list[tuple[int, str]]] = defaultdict(list)
        first: list[list[tuple[str, int]]] = [[]]
        for name, text in ((f"{label}/{i}", text) for label, texts in templates.items() for i, text in enumerate(texts)):
            tokens = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            self.sizes[name] = len(tokens)
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token, first)
                first[last].append((name, i))
        ends = []
        for text, label in phrases.items():
            tokens = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            last = 0
            for token in tokens:
                last = self._extend(last, token, first)
            ends.append((tokens, label))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for tokens, label in ends:
            state = 0
            for token in tokens:
                state = self.next[state][token]
            marks[state].append((len(tokens), label))
        self.phrase = [()] * len(self.length)
        for v in order:  # what ends with a longer string also ends with the shorter one
            self.phrase[v] = self.phrase[self.link[v]] + tuple(marks.get(v, ()))
        self.places = first
        for v in reversed(order):
            if self.link[v] > 0:
                self.places[self.link[v]].extend(self.places[v])
        self.places = [sorted(set(p)) for p in self.places]
        return self

    def _new(self, length: int, link: int, edges: dict[int, int], first) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        first.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int, first) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), first)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int, first) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token, first)
        made, p = self._new(self.length[last] + 1, 0, {}, first), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token, first)
        return made

    def statistics(self, tokens: list[int | None]):
        """(position, state, match length) at each word that some template holds."""
        state = size = 0
        nexts, link, length = self.next, self.link, self.length
        for i, token in enumerate(tokens):
            if token is None:
                state = size = 0
                continue
            to = nexts[state].get(token)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nexts[state].get(token)
            if to is None:
                state = size = 0
                continue
            state, size = to, size + 1
            yield i, state, size

    def scan(self, text: str | None) -> dict:
        """n_words, base (start, label) places, spans (start, end, label, share) and their labels."""
        words = words_of(text)
        tokens = list(map(self.vocab.get, words))
        base, matches, before = [], [], None
        for i, state, size in self.statistics(tokens):
            for n, label in self.phrase[state]:
                if n <= size:
                    base.append((i - n + 1, label))
            if before is not None and (before[0] + 1 != i or before[2] + 1 != size):  # the match before was maximal
                if before[2] >= LEAST_MATCH:
                    matches.append(before)
            before = (i, state, size)
        if before is not None and before[2] >= LEAST_MATCH:
            matches.append(before)
        return {"n_words": len(words), "base": sorted(base), "spans": self._chain(matches)}

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """(start, end, label, share) of the spans, from maximal matches in the order of their ends."""
        by: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for i, state, size in matches:
            for name, end in self.places[state]:
                by[name].append((i + 1, end + 1, size))
        made = []
        for name, found in by.items():
            chains: list[tuple[int, int]] = []  # words covered and first word of the best chain that ends with a match
            low = 0
            for k, (stop, at, size) in enumerate(found):
                best = (size, stop - size)
                while found[low][0] < stop - size - GAP:
                    low += 1
                for q in range(low, k):
                    end, there, _ = found[q]
                    over = max(0, end - (stop - size), there - (at - size))  # words that the chain has already
                    if over < size and stop - size + over - end <= GAP and 0 <= at - size + over - there <= GAP:
                        best = max(best, (chains[q][0] + size - over, chains[q][1]))
                chains.append(best)
            made += [(c, s, f[0], name) for (c, s), f in zip(chains, found) if c >= LEAST_SHARE * self.sizes[name]]
        spans, taken = set(), []
        for covered, start, stop, name in sorted(made, key=lambda x: (-x[0], x[1:])):
            place = bisect_left(taken, (start, stop))
            same = place < len(taken) and taken[place][:2] == (start, stop) and taken[place][2] == covered
            if not same and (place < len(taken) and taken[place][0] < stop or place and taken[place - 1][1] > start):
                continue
            if not same:
                insort(taken, (start, stop, covered))
            spans.add((start, stop, name.rpartition("/")[0], min(1.0, covered / self.sizes[name])))
        return sorted(spans)


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, phrases: dict[str, str] | None = None, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    score is 1 with a phrase, else the best covered share of a template, else 0.
    """
    automaton = Automaton.build(phrases or PHRASES, templates or TEMPLATES)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def start():
        automaton = shared.value

        def apply(texts):
            rows = []
            for text in texts:
                r = automaton.scan(text)
                base, spans = r["base"], r["spans"]
                labels = {x[1] for x in base}
                rows.append((r["n_words"], len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {s[2] for s in spans})), 1.0 if base else max((s[3] for s in spans), default=0.0), [f"{s[2]}:{s[0]}:{s[1]}" for s in spans]))
            return list(zip(*rows))

        return apply

    return map_text(docs, text_col, [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("spans", "array<string>")], start, keep)
