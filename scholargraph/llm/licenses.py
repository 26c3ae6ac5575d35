"""Licence scan: matching statistics by a generalised suffix automaton, chained into template spans.

The templates' words become one automaton of all their substrings. A text's words run through it once;
at each word the automaton knows the longest match that ends there. Maximal matches of enough words are
chained, in order of text and template with small gaps, and a template counts as found where a chain
covers enough of it. Whole licences are cut into paragraphs, each a template of its own, so that a licence
without its first or last paragraph is found by the others.
"""

from __future__ import annotations

import re
from collections import defaultdict
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Label and text of licence notices.
NOTICES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Phrases of the base rule and their labels.
PHRASES = ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved"))

#: ASCII letters in lower case, digits and all bytes of other characters; anything else parts words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Automaton:
    """The suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[bytes]]):
        self.go: list[dict[bytes, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, end) of the state's substrings
        for k, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                self.ends[last].add((k, i + 1))
        for s in sorted(range(1, len(self.go)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, go: dict, link: int) -> int:
        self.go.append(go)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.go) - 1

    def _split(self, p: int, w: bytes) -> int:
        """The state that p reaches by w, made to hold no substring longer than p's and w."""
        q = self.go[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.go[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.go[p]:
            self.go[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def matches(self, seq: list[bytes], least: int):
        """(start, end, state) of the maximal matches of at least ``least`` words, by end."""
        go, link, length = self.go, self.link, self.length
        known, state, n, best = go[0], 0, 0, (0, 0)
        for i, w in enumerate(seq):
            if w not in known:
                if n >= least:
                    yield i - n, i, best[1]
                state = n = 0
                continue
            if w not in go[state]:
                if n >= least:
                    yield i - n, i, best[1]
                while w not in go[state]:
                    state = link[state]
                n = length[state]
            state, n = go[state][w], n + 1
            best = (n, state)
        if n >= least:
            yield len(seq) - n, len(seq), state


def whole_licences(least: int = 12) -> tuple[tuple[str, str], ...]:
    """(label, paragraph) of the licence texts kept beside this module, files named label.txt or label_version.txt.

    Headings and other paragraphs under ``least`` words tell no licence from another and are left out.
    """
    files = sorted(resources.files("scholargraph.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name)
    texts = [(f.name.removesuffix(".txt").split("_")[0], p) for f in files for p in re.split(r"\n[ \t]*\n", f.read_text())]
    return tuple((label, p) for label, p in texts if len(words(p)) >= least)


TEMPLATES = NOTICES + whole_licences()
#: Words of a stretch under which kept spans are found by place.
_STRETCH = 16
#: template, first word, end, words covered by matches, their share of the template
Span = tuple[int, int, int, int, float]


class Scanner:
    """Finds templates (label, text). A match has ``least`` words, a chain's gaps ``gap`` words at most, a found one the share ``cover``."""

    def __init__(self, templates=TEMPLATES, least: int = 3, gap: int = 8, cover: float = 0.75):
        self.labels, sequences = [label for label, _ in templates], [words(t) for _, t in templates]
        self.sizes, self.least, self.gap, self.cover = [len(s) for s in sequences], least, gap, cover
        self.automaton = Automaton(sequences)

    def chains(self, seq: list[bytes]) -> tuple[list[Span], float]:
        """Every template's covered spans, those that overlap given once; the largest covered share of any.

        The best chain that ends with a match takes one before it that ends at most ``gap`` words back, in
        the text and in the template; what overlaps in either counts once. Matches come by their ends and
        starts, so chains that ended too long ago are let go.
        """
        live: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # by template: end in the text, end in it, words covered, first word
        found: dict[int, list[Span]] = defaultdict(list)
        most = 0.0
        for start, end, state in self.automaton.matches(seq, self.least):
            size = end - start
            added: dict[int, list] = defaultdict(list)
            for k, at in self.automaton.ends[state]:
                live[k] = [c for c in live[k] if c[0] >= start - self.gap]
                got, first = size, start
                for c_end, c_at, c_got, c_first in live[k]:
                    if at > c_at and end > c_end and at - size - c_at <= self.gap:
                        sum_ = c_got + min(size, at - c_at, end - c_end)
                        if sum_ > got:
                            got, first = sum_, c_first
                added[k].append((end, at, got, first))
                share = min(1.0, got / self.sizes[k])
                most = max(most, share)
                if share >= self.cover:
                    span = (k, first, end, got, share)
                    if found[k] and first < found[k][-1][2]:
                        if share >= found[k][-1][4]:
                            found[k][-1] = span
                    else:
                        found[k].append(span)
            for k, chains in added.items():
                live[k] += chains
        return [s for spans in found.values() for s in spans], most

    def stretch(self, spans: list[Span]) -> dict[str, int]:
        """How many words of the text the spans of each label stretch over; a word counts once."""
        total: dict[str, int] = defaultdict(int)
        last: dict[str, int] = defaultdict(int)
        for k, first, end, _, _ in sorted(spans, key=lambda s: s[1:3]):
            label = self.labels[k]
            total[label] += max(0, end - max(first, last[label]))
            last[label] = max(last[label], end)
        return total

    def found(self, seq: list[bytes]) -> tuple[list[Span], float]:
        """The spans by place, without those that lie for the most part in a span of another label with more words covered.

        Of equal ones, as paragraphs that several licences share, that of the label with more words in the text stays. What holds the most part of a span holds its middle, so each span meets only those kept there.
        """
        spans, most = self.chains(seq)
        kept: list[Span] = []
        over: dict[int, list[Span]] = defaultdict(list)  # by stretches of _STRETCH words
        total = self.stretch(spans)
        rank = lambda s: (s[3], total[self.labels[s[0]]])
        for s in sorted(spans, key=lambda s: (-s[3], -total[self.labels[s[0]]], s)):
            inside = lambda o: 2 * (min(s[2], o[2]) - max(s[1], o[1])) >= s[2] - s[1]  # noqa: E731, B023
            if not any(rank(o) > rank(s) and self.labels[o[0]] != self.labels[s[0]] and inside(o) for o in over[(s[1] + s[2]) // 2 // _STRETCH]):
                kept.append(s)
                for k in range(s[1] // _STRETCH, s[2] // _STRETCH + 1):
                    over[k].append(s)
        return sorted(kept, key=lambda s: (s[1], s[2], s[0])), most


def phrase_places(data: bytes, seq: list[bytes]) -> tuple[list[int], set[str]]:
    """Starts, in words, of all places of the base phrases, and their labels."""
    starts, labels = [], set()
    for phrase, label in _PHRASES:
        if any(w not in data for w in phrase):
            continue
        head, n = phrase[0], len(phrase)
        for i, w in enumerate(seq):
            if w == head and tuple(seq[i : i + n]) == phrase:
                starts.append(i)
                labels.add(label)
    return starts, labels


_PHRASES = tuple((tuple(w.encode() for w in p), label) for p, label in PHRASES)


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, template_spans.

    ``template_spans`` lists what the chains cover as label:first word:end:share in hundredths, by place. A
    null text is empty: no words, null places, empty labels, score 0. Null and repeated ids keep a row each,
    repeated rows repeat it; other columns don't matter. Time is linear in the text; a state's template
    places are as many as the templates have words.
    """
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.string()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "template_spans"]

    def run(batches):
        scanner = Scanner(templates, **how)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode().translate(_TABLE)
                seq = data.split()
                starts, base = phrase_places(data, seq)
                spans, score = scanner.found(seq)
                more = {scanner.labels[s[0]] for s in spans}
                told = ",".join(f"{scanner.labels[k]}:{first}:{end}:{int(100 * share)}" for k, first, end, _, share in spans)
                row = (doc, len(seq), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score, told)
                for col, v in zip(out, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, template_spans string")
