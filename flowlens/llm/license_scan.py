"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds all templates and phrases. A text streams through it once: at every word it
gives the longest suffix that stands in some template (the matching statistics). Long maximal
matches chain, in order and with small gaps, into spans of a template; a template counts where its
words are covered. Phrases count wherever one ends in the current match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowlens.llm.decontaminate import SEPARATOR
from flowlens.llm.textops import Words, replaced, slices, utf8

#: Phrase -> label; fixed values.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: (label, text): well-known licence notices, then whole licences; fixed values.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "licensed under the GNU General Public License, version 2"),
    ("lgpl", "licensed under the GNU Lesser General Public License, version"),
    ("agpl", "licensed under the GNU Affero General Public License, version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]

SPAN = "array<struct<label:string,start:bigint,stop:bigint,coverage:double>>"


class Automaton:
    """Suffix automaton of several sequences of numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, int]] = [{}]  # sequence -> end of the state's words in it
        for k, sequence in enumerate(sequences):
            last = 0
            for end, token in enumerate(sequence, 1):
                last = self._extend(last, token)
                self.places[last].setdefault(k, end)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for k, end in self.places[state].items():
                if self.link[state] > 0:
                    had = self.places[self.link[state]]
                    had[k] = min(end, had.get(k, end))

    def _state(self, length: int, link: int, next_: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(next_)
        self.places.append({})
        return len(self.link) - 1

    def _clone(self, p: int, token: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # the words stand in an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, token, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, token, q)
        return new

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest known suffix at each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(token, 0)
            length = length + 1 if state else 0
            yield state, length


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], least: int, gap: int, coverage: float):
        texts = [t for _, t in templates] + list(phrases)
        self.labels = [label for label, _ in templates] + list(phrases.values())
        self.n_templates, self.least, self.gap, self.coverage = len(templates), least, gap, coverage
        w = Words([t.encode() for t in texts], True, SEPARATOR)
        self.vocabulary = np.unique(w.hash)
        ids = np.searchsorted(self.vocabulary, w.hash)
        sequences = [ids[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.shortest = max(1, min([*self.sizes[self.n_templates :], least]))
        # For each state the phrases that can end in it.
        ends: dict[int, list[int]] = {}
        for k in range(self.n_templates, len(sequences)):
            state = 0
            for token in sequences[k]:
                state = self.automaton.next[state][token]
            ends.setdefault(state, []).append(k)
        self.phrases: list[tuple[int, ...]] = []
        for state in range(len(self.automaton.link)):
            got, at = [], state
            while at > 0:
                got += ends.get(at, [])
                at = self.automaton.link[at]
            self.phrases.append(tuple(got))

    def run(self, tokens: list[int], start: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrases (number, first word) and maximal matches (template, start, stop, end in it) of known words."""
        found, matches = [], []
        before = (0, 0)
        for at, (state, length) in enumerate([*self.automaton.statistics(tokens), (0, 0)]):
            if before[1] >= self.least and length != before[1] + 1:
                for k, end in self.automaton.places[before[0]].items():
                    if k < self.n_templates:
                        matches.append((k, start + at - before[1], start + at, end))
            for k in self.phrases[state]:
                if length >= self.sizes[k]:
                    found.append((k, start + at + 1 - self.sizes[k]))
            before = (state, length)
        return found, matches

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans of templates with enough words covered by matches in order and near each other.

        Matches come by their first word, so a span that ends more than `gap` before one takes no later
        one either: only spans that still can grow are looked at, and the work is that of the matches.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, *place in matches:
            by.setdefault(k, []).append(tuple(place))
        out = []
        for k, places in sorted(by.items()):
            spans: list[list[int]] = []  # start, stop, end in the template, words covered
            growing: list[list[int]] = []
            for start, stop, end in sorted(places):
                n = stop - start
                growing = [c for c in growing if c[1] >= start - self.gap]
                for c in reversed(growing):
                    skipped = end - n - c[2]
                    if 0 <= start - c[1] and -n < skipped <= 2 * self.gap and end > c[2]:
                        c[3] += min(n, end - c[2])
                        c[1], c[2] = stop, end
                        break
                else:
                    spans.append([start, stop, end, n])
                    growing.append(spans[-1])
            out += [(self.labels[k], c[0], c[1], min(1.0, c[3] / self.sizes[k])) for c in spans if c[3] >= self.coverage * self.sizes[k]]
        return sorted(out)


def scan(
    df: DataFrame,
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
    least: int = 4,
    gap: int = 8,
    coverage: float = 0.7,
) -> DataFrame:
    """df with the licences of its texts.

    New columns, which replace those of these names: n_words; n_base (places of phrases), first_word
    and last_word (their smallest and largest start, else null), base_labels and labels (distinct,
    sorted, comma-joined; labels has the templates' too), score (the largest coverage; 1 with a
    phrase, 0 with nothing) and spans (of templates, in words). Words are runs of ASCII letters,
    digits and non-ASCII, ASCII lower-cased. Null and empty texts have none. Rows are judged one by
    one, so repeated rows and ids, and null ids, are results like others.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, least, gap, coverage)
    new = [
        *(T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")),
        *(T.StructField(c, T.StringType()) for c in ("base_labels", "labels")),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T._parse_datatype_string(SPAN)),
    ]
    schema = replaced(df.schema, new)
    kept = [df.columns.index(f.name) for f in schema.fields[: -len(new)]]
    text_at = df.columns.index(text_col)
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
    shared = df.sparkSession.sparkContext.broadcast(scanner)  # of the size of the templates

    def row(n: int, found: list[tuple[int, int]], spans: list[tuple[str, int, int, float]], labels: list[str]) -> tuple:
        base = {labels[k] for k, _ in found}
        places = [at for _, at in found]
        score = 1.0 if found else max((s[3] for s in spans), default=0.0)
        named = [dict(zip(("label", "start", "stop", "coverage"), s, strict=True)) for s in spans]
        return n, len(found), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), score, named

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            texts, rows = utf8(b.column(text_at)), []
            for i, j in slices(texts):
                w = Words(texts[i:j], True, SEPARATOR)
                at = np.searchsorted(s.vocabulary, w.hash)
                at[at == len(s.vocabulary)] = 0
                known = s.vocabulary[at] == w.hash
                # Runs of known words of one text; shorter ones hold no phrase and no long match.
                edge = np.concatenate([[True], (known[1:] != known[:-1]) | (w.doc[1:] != w.doc[:-1]), [True]]) if len(known) else np.zeros(0, bool)
                edge = np.flatnonzero(edge)
                long = np.flatnonzero((np.diff(edge) >= s.shortest) & known[edge[:-1]]) if len(edge) else []
                found: dict[int, tuple[list, list]] = {}
                for r in long:
                    a, z = edge[r], edge[r + 1]
                    d = int(w.doc[a])
                    phrases_, matches = s.run(at[a:z].tolist(), int(a - w.first[d]))
                    if phrases_ or matches:
                        had = found.setdefault(d, ([], []))
                        had[0].extend(phrases_)
                        had[1].extend(matches)
                sizes = np.diff(w.first).tolist()
                for d in range(j - i):
                    phrases_, matches = found.get(d, ([], []))
                    rows.append(row(sizes[d], phrases_, s.chain(matches), s.labels))
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *new], names=schema.names)

    return df.mapInArrow(run, schema)
