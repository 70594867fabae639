"""License scans with a generalised suffix automaton over the words of licence templates.

Each text is streamed through the automaton once: at every word it knows the longest run of words ending
there that occurs in any template (the matching statistic). Long maximal matches of one passage of a template are
then chained, in order on both sides, by dynamic programming; a chain that covers enough of the passage is a span.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import text as tx

#: Phrases that name a licence wherever their words stand consecutively.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by label, a passage each: what grants a licence and on which terms, and the lines that name it. Disclaimers, which
#: several licences share, are left out. Passages are matched by words.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License", "Licensed under the MIT License",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Licensed under CC BY-ND 4.0"),
    "cc-by-nc-sa": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Licensed under CC BY-NC-SA 4.0"),
    "cc-by-nc-nd": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Licensed under CC BY-NC-ND 4.0"),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, Version 2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
}
#: Words of the shortest match that is chained and of a span at least, and the share of a passage's words that a span must cover.
MIN_MATCH, MIN_SPAN, MIN_SHARE = 3, 5, 0.6
#: Words that a chain may skip on either side between two matches.
MAX_GAP = 8
#: Words that tell one licence's wording from another's. No chain skips one, and part of a passage is none beside one.
TELLING = ("affero", "apache", "artistic", "boost", "bsd", "eclipse", "isc", "lesser", "library", "mit", "mozilla", "nc", "nd", "noderivatives", "noderivs", "noncommercial", "sa", "sharealike", "zlib")

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_words(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


class SuffixAutomaton:
    """Of several word sequences: every run of words of any of them leads from state 0 to one state."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, at))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The target of state over word, cut off so that its longest run is one longer than that of state."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """The state and matching statistic after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        return (self.next[state][word], matched + 1) if word in self.next[state] else (0, 0)


def chain(matches: list[tuple[int, int, int]], gap: int, clear: Callable[[int, int, int, int], bool] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, covered words) of chains of matches (text end, template end, length) of one passage, the best first.

    A match may follow another that ends before it on both sides, over at most gap words of each; where they overlap, words
    count once. clear says whether the words between two places of the text and two of the passage (ends exclusive) may be
    skipped; without it, all may. The best chain to each match follows from those that end within its reach, which is bounded by the passage's
    length: so the work grows with the matches. A match is in one chain only.
    """
    matches = sorted(set(matches))
    best, came = [length for _, _, length in matches], [-1] * len(matches)
    by_place: dict[int, list[int]] = {}
    for k, (end, template, length) in enumerate(matches):
        for place in range(template - length - gap, template):
            for j in reversed(by_place.get(place, ())):
                skipped, apart = end - length - matches[j][0], template - length - place
                if skipped > gap:
                    break
                overlap = max(0, -skipped, -apart)
                if matches[j][0] < end and overlap < length and best[j] + length - overlap > best[k] and (clear is None or clear(matches[j][0] + 1, end - length + 1, place + 1, template - length + 1)):
                    best[k], came[k] = best[j] + length - overlap, j
        by_place.setdefault(template, []).append(k)
    used, out = [False] * len(matches), []
    for k in sorted(range(len(matches)), key=lambda i: (-best[i], i)):
        at, start = k, None
        while at >= 0 and not used[at]:
            used[at], start, at = True, at, came[at]
        if start is not None:
            out.append((matches[start][0] - matches[start][2] + 1, matches[k][0] + 1, best[k] - (best[at] if at >= 0 else 0)))
    return out


class Scanner:
    """Vocabulary, automaton and phrases of a set of templates; small, and sent to the tasks with their code."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, tuple[str, ...]], min_match: int, min_span: int, min_share: float, gap: int, telling: Sequence[str] = ()):
        self.min_match, self.min_span, self.min_share, self.gap = min_match, min_span, min_share, gap
        said = [(template_words(p), label) for p, label in phrases.items()] + [(template_words(t), label) for label, parts in templates.items() for t in parts]
        said = [x for x in said if x[0]]
        self.labels, self.lengths = [label for _, label in said], [len(x) for x, _ in said]
        self.n_phrases = len(phrases)
        vocabulary = sorted({w for x, _ in said for w in x} | set(telling))
        raw = "".join(vocabulary).encode()
        ends = np.cumsum([len(w.encode()) for w in vocabulary])
        hashes = tx.Hashes(np.frombuffer(raw, np.uint8)).of(np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        self.known, number = hashes[order], {vocabulary[k]: i for i, k in enumerate(order)}
        sequences = [[number[w] for w in x] for x, _ in said]
        self.automaton = SuffixAutomaton(sequences)
        self.telling = np.zeros(len(vocabulary) + 1, bool)
        self.telling[[number[w] for w in telling]] = True
        self.told = [np.concatenate([[0], np.cumsum(self.telling[x])]).tolist() for x in sequences]
        own: dict[int, list[int]] = {}
        for k, x in enumerate(sequences[: self.n_phrases]):
            state = 0
            for w in x:
                state = self.automaton.next[state][w]
            own.setdefault(state, []).append(k)
        spoken: list[list[int]] = [[] for _ in self.automaton.link]  # by state: the phrases that end there, where the match is as long
        for state in sorted(range(1, len(spoken)), key=lambda s: self.automaton.length[s]):
            spoken[state] = spoken[self.automaton.link[state]] + own.get(state, [])
        self.spoken = spoken
        self.pairs = np.zeros((len(vocabulary) + 1, len(vocabulary) + 1), bool)
        for x in sequences:
            for a, b in zip(x, x[1:], strict=False):
                self.pairs[a, b] = True
        self.single = {x[0]: k for k, x in enumerate(sequences[: self.n_phrases]) if len(x) == 1}

    def runs(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, and the stretches of words in which a match of two words or more can lie."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        word = np.where(self.known[at] == hashes, at, len(self.known))
        if len(word) < 2:
            return word, np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = np.concatenate([[False], self.pairs[word[:-1], word[1:]] & (owner[:-1] == owner[1:]), [False]])
        edges = np.flatnonzero(joined[1:] != joined[:-1])
        return word, edges[0::2], edges[1::2] + 1

    def scan(self, word: np.ndarray, begin: int, end: int, base: list, found: dict) -> None:
        """Adds the phrase places of words begin to end of one row, and its maximal matches by template."""
        state = matched = 0
        for at in range(begin, end):
            was, before = state, matched
            state, matched = self.automaton.step(state, matched, int(word[at]))
            if matched <= before:
                self._keep(was, before, at - 1, found)
            base += [(at - self.lengths[k] + 1, k) for k in self.spoken[state] if matched >= self.lengths[k] > 1]
        self._keep(state, matched, end - 1, found)

    def _keep(self, state: int, matched: int, at: int, found: dict) -> None:
        if matched >= self.min_match:
            for number, last in self.automaton.ends[state]:
                if number >= self.n_phrases:
                    found.setdefault(number, []).append((at, last, matched))

    def spans(self, found: dict, told: np.ndarray, low: int, high: int) -> list[tuple[str, int, int, float]]:
        """(label, start, end, share of the passage that is covered); spans don't overlap, the larger cover goes first.

        told counts the telling words before each word of a slice; low and high bound the text's own.
        """
        held = []
        for number, matches in found.items():
            own = self.told[number]
            clear = lambda a, b, c, d: (a >= b or told[a] == told[b]) and (c >= d or own[c] == own[d])  # noqa: B023, E731
            for start, end, covered in chain(matches, self.gap, clear):
                whole = covered >= self.lengths[number]
                beside = not whole and told[max(start - 1, low)] != told[start] or not whole and told[end] != told[min(end + 1, high)]
                if covered >= self.min_span and covered >= self.min_share * self.lengths[number] and not beside:
                    held.append((-covered, -covered / self.lengths[number], end - start, self.labels[number], start))
        out: list[tuple[int, int, str, float]] = []
        for _, share, width, label, start in sorted(held):
            at = bisect.bisect(out, (start, start + width))
            if (at == 0 or out[at - 1][1] <= start) and (at == len(out) or out[at][0] >= start + width):
                out.insert(at, (start, start + width, label, -share))
        return [(label, start, end, share) for start, end, label, share in out]


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    min_match: int = MIN_MATCH,
    min_span: int = MIN_SPAN,
    min_share: float = MIN_SHARE,
    max_gap: int = MAX_GAP,
    telling: Sequence[str] = TELLING,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per text: words, phrase places, and spans (label, start, end in words, coverage).

    base_* columns come from the phrases, labels from phrases and spans. A null or empty text has no words
    and no places; ties between templates over one place go to the larger cover, then the first label.
    Repeated rows are scanned each on their own, an empty table gives an empty one, and further columns
    (whatever their names) are not read. coverage is the share of a passage's words that a span covers, min_share
    at least; score is the best of them, 1 where a phrase stands whole. No span skips a word of telling, on either side, nor
    is a part of a passage one that stops at such a word.
    """
    scanner = Scanner(phrases, templates, min_match, min_span, min_share, max_gap, telling)
    schema = "key long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,coverage:double>>"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), span]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.slices(batch.column(1)):
                data = tx.lower(data)
                starts, ends, first = tx.words(data, offsets, tx.ALNUM)
                owner = tx.owners(first)
                word, begins, closes = scanner.runs(tx.Hashes(data).of(starts, ends), owner)
                told = np.concatenate([[0], np.cumsum(scanner.telling[word])])
                base: dict[int, list] = {}
                found: dict[int, dict] = {}
                for begin, close in zip(begins.tolist(), closes.tolist(), strict=True):
                    row = int(owner[begin])
                    scanner.scan(word, begin, close, base.setdefault(row, []), found.setdefault(row, {}))
                if scanner.single:
                    for at in np.flatnonzero(np.isin(word, list(scanner.single))).tolist():
                        base.setdefault(int(owner[at]), []).append((at, scanner.single[int(word[at])]))
                n = np.diff(first)
                out = []
                for row in range(high - low):
                    places, spans = base.get(row, []), scanner.spans(found.get(row, {}), told, int(first[row]), int(first[row + 1]))
                    shift = int(first[row])
                    own = {scanner.labels[k] for _, k in places}
                    at = [x - shift for x, _ in places]
                    out.append((int(n[row]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in spans})), 1.0 if at else max((x[3] for x in spans), default=0.0), [{"label": a, "start": b - shift, "end": c - shift, "coverage": d} for a, b, c, d in spans]))
                columns = [batch.column(0)[low:high], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return tx.arrow_map(rows, scan, schema).withColumnRenamed("key", key)
