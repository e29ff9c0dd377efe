"""License scans with a generalised suffix automaton of licence words.

All templates go into one automaton. Each text is streamed through it for matching
statistics (at every word, the longest suffix that occurs in some template); long
matches are chained, in template order and over small gaps, into covered template spans.
Templates are whole licences and notices, and apart from them short statements and
opening clauses, as texts often hold no more.
Words outside the templates' vocabulary, and word pairs that no template has, end any
match of two words or more, so numpy finds the stretches between them first and the
automaton walks those only. Documents are independent: no shuffle, bounded memory.

Defined results. Templates with fewer words than a match, and phrases without words, are
errors; without any of them texts have words only. Null, empty or wordless text: no words, no spans, score 0. Repeated
rows: a result each. A null id stays null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bytewords import ALNUM, find_words, slices, text_buffer
from sparkloom.llm.shared import table

#: Phrases to be found wherever their words stand consecutively, and labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short statements and opening clauses, and labels.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: Whole licences and notices in their public wording, without title and
#: copyright line, and labels.
LICENCES = {
    "apache-2.0-text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "boost-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless
such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "gpl-text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this
program. If not, see https://www.gnu.org/licenses/.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0-text": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs
and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
SPANS = "array<struct<label:string,start:int,end:int,matched:int,coverage:double>>"
OUT = f"n_words long, phrases array<struct<label:string,start:int>>, spans {SPANS}"


def words_of(text: str) -> list[str]:
    raw = text.encode()
    w = find_words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), ALNUM, lower=True)
    return w.texts()


@dataclass
class State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    ends: dict[int, set[int]] = field(default_factory=dict)  # template: where strings of this state end in it
    phrases: list[tuple[int, int]] = field(default_factory=list)  # (words, phrase) that end wherever this state's strings do


class Automaton:
    def __init__(self, templates: list[list[int]], phrases: list[list[int]]):
        self.states = [State(0, -1)]
        for t, words in enumerate(templates + phrases):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.states[last].ends.setdefault(t, set()).add(i + 1)
        order = sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length)
        for s in order:  # what ends with a longer string ends with its suffixes
            for t, ends in self.states[s].ends.items():
                self.states[self.states[s].link].ends.setdefault(t, set()).update(ends)
        own: dict[int, list[tuple[int, int]]] = {}
        for p, words in enumerate(phrases):
            s = 0
            for w in words:
                s = self.states[s].next[w]
            own.setdefault(s, []).append((len(words), p))
        for s in reversed(order):
            self.states[s].phrases = own.get(s, []) + (self.states[self.states[s].link].phrases if self.states[s].link else [])

    def _extend(self, last: int, w: int) -> int:
        st = self.states
        if w in st[last].next:
            q = st[last].next[w]
            return q if st[q].length == st[last].length + 1 else self._clone(last, w, q)
        new = len(st)
        st.append(State(st[last].length + 1, 0))
        p = last
        while p >= 0 and w not in st[p].next:
            st[p].next[w] = new
            p = st[p].link
        if p >= 0:
            q = st[p].next[w]
            st[new].link = q if st[q].length == st[p].length + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        st = self.states
        copy = len(st)
        st.append(State(st[p].length + 1, st[q].link, dict(st[q].next)))
        while p >= 0 and st[p].next.get(w) == q:
            st[p].next[w] = copy
            p = st[p].link
        st[q].link = copy
        return copy

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        st, s, n = self.states, 0, 0
        for w in words:
            while s and w not in st[s].next:
                s = st[s].link
                n = st[s].length
            if w in st[s].next:
                s, n = st[s].next[w], n + 1
            yield s, n


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_match: int, max_gap: int, min_coverage: float):
        from sparkloom.llm.bytewords import SPACED

        self.labels, self.phrase_labels = list(templates), list(phrases.values())
        texts, phrase_texts = [words_of(t) for t in templates.values()], [words_of(t) for t in phrases]
        vocabulary = sorted({w for t in texts + phrase_texts for w in t})
        raw = " ".join(vocabulary).encode()
        hashes = find_words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), SPACED).hashes()
        order = np.argsort(hashes)
        self.hashes, ids = hashes[order], {vocabulary[k]: i for i, k in enumerate(order.tolist())}
        coded, phrases_coded = [[ids[w] for w in t] for t in texts], [[ids[w] for w in t] for t in phrase_texts]
        self.lengths = [len(t) for t in coded]
        if short := [k for k, n in zip(self.labels, self.lengths) if n < max(1, min_match)]:
            raise ValueError(f"templates of fewer than {min_match} words can't be matched: {short}")
        if empty := [p for p, t in zip(phrases, phrases_coded) if not t]:
            raise ValueError(f"phrases without words: {empty}")
        self.automaton = Automaton(coded, phrases_coded)
        self.n = len(vocabulary)
        self.pairs = np.unique([a * self.n + b for t in coded + phrases_coded for a, b in zip(t, t[1:])]).astype(np.int64)
        self.single = np.unique([t[0] for t in phrases_coded if len(t) == 1]).astype(np.int64)
        self.min_match, self.max_gap, self.min_coverage = min_match, max_gap, min_coverage

    def scan(self, column: pa.Array) -> tuple[np.ndarray, list, list]:
        words = find_words(*text_buffer(column), ALNUM, lower=True)
        if not self.n:
            return words.counts(), [[] for _ in range(len(column))], [[] for _ in range(len(column))]
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
        code = np.where(self.hashes[at] == h, at, -1)
        known = (code[:-1] >= 0) & (code[1:] >= 0)
        known[words.first[1:-1][(words.first[1:-1] > 0) & (words.first[1:-1] < len(h))] - 1] = False  # pairs over a border
        pair = np.flatnonzero(known)
        key = code[pair] * self.n + code[pair + 1]
        pair = pair[np.isin(key, self.pairs)]
        rows = len(words.first) - 1
        phrases: list[list] = [[] for _ in range(rows)]
        matches: dict[int, list] = {}
        inside = np.zeros(len(h), bool)
        inside[pair] = inside[pair + 1] = True
        alone = np.flatnonzero(np.isin(code, self.single) & ~inside) if len(self.single) else np.zeros(0, np.int64)
        if len(pair) or len(alone):
            new = np.diff(pair, prepend=-2) > 1
            starts, ends = np.r_[pair[new], alone], np.r_[pair[np.r_[new[1:], True][: len(pair)]] + 2, alone + 1]
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
            docs = np.searchsorted(words.first, starts, "right") - 1
            for d, a, b in zip(docs.tolist(), starts.tolist(), ends.tolist()):
                base = a - int(words.first[d])
                found = list(self.automaton.statistics(code[a:b].tolist()))
                for i, (s, n) in enumerate(found):
                    for m, p in self.automaton.states[s].phrases:
                        if m <= n:
                            phrases[d].append({"label": self.phrase_labels[p], "start": base + i + 1 - m})
                    if n >= self.min_match and (i + 1 == len(found) or found[i + 1][1] <= n):
                        matches.setdefault(d, []).append((base + i + 1, n, s))
        spans: list[list] = [[] for _ in range(rows)]
        for d, found in matches.items():
            spans[d] = self.chain(found)
        return words.counts(), phrases, spans

    def chain(self, found: list[tuple[int, int, int]]) -> list[dict]:
        """Matches (end, length, state) in text order, joined for each template."""
        open_: dict[int, list[int]] = {}  # template: start, end, end in the template, matched words
        spans = []

        def close(t: int) -> None:
            start, end, _, matched = open_.pop(t)
            if matched >= self.min_coverage * self.lengths[t]:
                spans.append({"label": self.labels[t], "start": start, "end": end, "matched": matched, "coverage": matched / self.lengths[t]})

        for end, n, s in found:
            for t, ends in self.automaton.states[s].ends.items():
                if t >= len(self.lengths):
                    continue
                if t in open_ and end - n - open_[t][1] > self.max_gap:
                    close(t)
                later = [e for e in ends if t in open_ and e > open_[t][2]]
                if t in open_ and later:
                    e = min(later)
                    fresh = min(n, end - open_[t][1], e - open_[t][2])
                    open_[t][1:] = [end, e, open_[t][3] + fresh]
                else:
                    if t in open_:
                        close(t)
                    open_[t] = [end - n, end, min(e for e in ends if e >= n), n]
        for t in list(open_):
            close(t)
        return sorted(spans, key=lambda x: (x["start"], x["label"]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES | LICENCES, phrases: dict[str, str] = PHRASES, min_match: int = 3, max_gap: int = 4, min_coverage: float = 0.75) -> DataFrame:
    """(doc_id, n_words, phrases, spans) for every row; positions count words from 0. The
    templates travel with the task: they are a parameter, not data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, min_match, max_gap, min_coverage)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, hits, spans = scanner.scan(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hits, HITS), pa.array(spans, SPAN)], ["doc_id", "n_words", "phrases", "spans"])

    HITS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32())]))
    SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.int32()), ("coverage", pa.float64())]))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {OUT}")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base, own = F.array_distinct(F.col("phrases.label")), F.array_distinct(F.col("spans.label"))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.start").cast("long").alias("first_word"), F.array_max("phrases.start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))).alias("score"),
    )
