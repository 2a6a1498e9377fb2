"""License scan: which license templates stand in a text, how completely, and where.

Texts and templates are sequences of words, reduced to lower-case letters and digits.
Templates are fingerprinted by winnowing (of the hashes of four-word grams, the smallest
of every two neighbours), kept in an inverted index from gram to places. A text's own
winnowed grams look up hits, which are chained in the order of both, also across up to
``GAP`` words that only the text has and any number that only the template has. Between
the hits of a chain, and before and after it, the words near them are aligned; reported
are the share of template words that align with equal words, and the span of characters
from the first to the last of them (inserted words included).

The index grows with the templates only and travels with the tasks; a text needs no
other text, so nothing is shuffled.

Defined cases: null and empty texts give no rows; a template that stands twice gives two
rows; equal rows give equal results; an empty table gives an empty result; no other
columns are carried.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import ID, TEXT, held_rows
from .sketches import mix

GRAM, WINNOW, BAND, GAP, MIN_COVERAGE = 4, 2, 8, 200, 0.75

# fixed values: notices of common licenses
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def normal(word: str) -> str:
    return re.sub(r"[\W_]+", "", word.lower())


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hashes of all grams; those with a word of no template are the largest number."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(GRAM):
        part = ids[k:k + n]
        known &= part >= 0
        out = mix(out ^ part.astype(np.int64).view(np.uint64), k)
    return np.where(known, out >> np.uint64(1), np.uint64(2**64 - 1))


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Places of grams that are the smallest of some ``WINNOW`` neighbours."""
    if len(grams) < WINNOW:
        return np.arange(len(grams))
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


class Index:
    """Templates as word ids, and their winnowed grams from hash to places."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.vocabulary, self.words = list(templates), {}, []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, text in enumerate(templates.values()):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in map(normal, text.split()) if w]
            self.words.append(np.array(ids, np.int64))
            grams = _grams(self.words[-1])
            for p in winnowed(grams):
                self.places[int(grams[p])].append((t, int(p)))
        self.keys = np.array(sorted(self.places), np.uint64)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
        """(template, chain): hits as (place in the text, place in the template)."""
        grams = _grams(ids)
        if not len(grams) or not len(self.keys):
            return []
        near = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        if not (self.keys[near] == grams).any():
            return []
        chosen = winnowed(grams)
        by_template = defaultdict(list)
        for p in chosen[self.keys[near[chosen]] == grams[chosen]]:
            for t, q in self.places[int(grams[p])]:
                by_template[t].append((int(p), q))
        return [(t, chain) for t, hits in sorted(by_template.items()) for chain in chains(hits, len(self.words[t]))]


def chains(hits: list[tuple[int, int]], length: int) -> list[list[tuple[int, int]]]:
    """Hits in chains that ascend in text and template, those of most words first; each hit
    is in one of them."""
    hits = sorted(hits)
    p, q = np.array(hits, np.int64).T
    score, before = np.full(len(hits), float(GRAM)), np.full(len(hits), -1)
    low = np.searchsorted(p, p - length - GAP)
    for k in range(1, len(hits)):
        at = slice(low[k], k)
        dp, dq = p[k] - p[at], q[k] - q[at]
        apart = np.abs(dp - dq)
        fits = (dp > 0) & (dq > 0) & (dp - dq <= GAP) & ((apart == 0) | (np.minimum(dp, dq) >= GRAM))
        if fits.any():
            gain = np.where(fits, score[at] + np.minimum(np.minimum(dp, dq), GRAM) - np.where(apart > 0, 0.5 + apart * 1e-3, 0), -np.inf)
            best = int(gain.argmax())
            if gain[best] > score[k]:
                score[k], before[k] = gain[best], low[k] + best
    out, used = [], np.zeros(len(hits), bool)
    for end in np.argsort(-score, kind="stable"):
        chain, k = [], int(end)
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(hits[k])
            k = int(before[k])
        if chain:
            out.append(chain[::-1])
    return out


def common(template: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (place in the template, place in the text) of a longest common subsequence."""
    if not len(template) or not len(text):
        return []
    table = np.zeros((len(template) + 1, len(text) + 1), np.int32)
    for i, word in enumerate(template):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (text == word)))
    out, i, j = [], len(template), len(text)
    while i and j:
        if template[i - 1] == text[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align_chain(template: np.ndarray, text: np.ndarray, chain: list[tuple[int, int]]) -> np.ndarray:
    """The places in the text of the equal words along a chain and near it, in order."""
    equal: dict[int, int] = {}  # place in the template: in the text
    for p, q in chain:
        for k in range(GRAM):
            if text[p + k] == template[q + k]:
                equal.setdefault(q + k, p + k)
    known = [(-1, -1), *sorted(equal.items()), (len(template), len(text))]
    for (q, p), (q_next, p_next) in zip(known, known[1:]):
        if q_next - q > 1:
            reach = q_next - q - 1 + BAND
            after = np.arange(p + 1, min(p + 1 + reach, p_next)) if q >= 0 else np.zeros(0, np.int64)
            ahead = np.arange(max(p_next - reach, p + 1), p_next) if q_next < len(template) else np.zeros(0, np.int64)
            places = np.union1d(after, ahead)
            equal.update((q + 1 + i, int(places[j])) for i, j in common(template[q + 1:q_next], text[places]))
    return np.sort(np.fromiter(equal.values(), np.int64, len(equal)))


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """The most equal words of an alignment that stays within ``band`` of the diagonal, and
    the places in the text of its first and last equal word."""
    width = 2 * band + 1
    score, start = np.zeros(width + 1, np.int64), np.full(width + 1, -1)
    best = (0, -1, -1)
    for i in range(len(template)):
        at = diagonal + i + np.arange(-band, band + 1)
        inside = (at >= 0) & (at < len(text))
        equal = inside & (text[np.clip(at, 0, max(len(text) - 1, 0))] == template[i])
        # along the diagonal, from the template's word left out (one to the right), or
        # from the text's word left out (one to the left, swept below)
        stay, drop = score[:width] + equal, score[1:]
        begun = np.where(equal & (start[:width] < 0), at, start[:width])
        new, new_start = np.where(stay >= drop, stay, drop), np.where(stay >= drop, begun, start[1:])
        for j in range(1, width):
            if new[j - 1] > new[j]:
                new[j], new_start[j] = new[j - 1], new_start[j - 1]
        hits = np.flatnonzero(equal & (new == stay) & (stay > best[0]))
        if len(hits):
            j = hits[np.argmax(stay[hits])]
            best = (int(stay[j]), int(new_start[j]), int(at[j]))
        score, start = np.append(new, 0), np.append(new_start, -1)
    return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, template, coverage, n_matched, start_char, end_char)``, code points from 0,
    the end not included; of matches of several templates that overlap all are told."""
    index = Index(templates if templates is not None else TEMPLATES)
    schema = f"{ID} bigint, template string, coverage double, n_matched int, start_char int, end_char int"

    def scan(batches):
        for batch in batches:
            ids, texts, out = batch.column(0), batch.column(1), []
            lists = pc.ascii_split_whitespace(texts)
            coded = pc.dictionary_encode(lists.flatten())
            table = np.fromiter((-2 if not (w := normal(x)) else index.vocabulary.get(w, -1) for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            every = table[coded.indices.to_numpy()] if len(table) else np.zeros(0, np.int64)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for row in range(len(batch)):
                words = every[bounds[row]:bounds[row + 1]]
                real = np.flatnonzero(words != -2)  # signs alone are no words
                found = index.candidates(words[real])
                spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[row].as_py())] if found else []
                last_t, left = -1, words[real]
                for t, chain in found:
                    if t != last_t:  # words told for one match of a template count for no other of it
                        last_t, left = t, words[real].copy()
                    if all((left[p:p + GRAM] < 0).all() for p, _ in chain):
                        continue
                    equal = align_chain(index.words[t], left, chain)
                    coverage = len(equal) / len(index.words[t])
                    if len(equal) and coverage >= min_coverage:
                        left[equal] = -1
                        out.append((ids[row].as_py(), index.names[t], coverage, len(equal), spans[real[equal[0]]][0], spans[real[equal[-1]]][1]))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [ID, "template", "coverage", "n_matched", "start_char", "end_char"])

    return held_rows(docs, id_col, text_col).select(ID, TEXT).mapInArrow(scan, schema)
