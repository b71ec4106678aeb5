"""License scans: patience alignment of texts with license templates.

A notice that stands together is found by aligning the stretches of a text that hold enough of a template's words. One that something interrupts, be it a
page of other text, leaves pieces: runs of words that the template has in the same order. The pieces of a text that continue each other in the template are
joined, without what lies between them, and the joined region is aligned whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import WordTable, bare

COVERAGE = 0.8
RUN = 5  # words in a row that make a piece of an interrupted notice

# The wording of widespread notices and licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "bsd-3-clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
        "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked "
        "as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    tops: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        if at == len(tops):
            tops.append(v)
            tails.append(i)
        else:
            tops[at], tails[at] = v, i
        before[i] = tails[at - 1] if at else -1
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, rising in both.

    Equal ends of a range match first. Within, words that occur once in both sides are anchors if they lie on a longest increasing
    subsequence; the gaps between anchors are aligned the same way. A range without an anchor matches nothing more.
    """
    out: list[tuple[int, int]] = []
    ranges = [(0, len(text), 0, len(template))]
    while ranges:
        a, b, c, d = ranges.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if theirs[w] == 1}
        shared = [(i, place[w]) for i, w in enumerate(text[a:b], a) if ours[w] == 1 and w in place]
        anchors = [shared[k] for k in rising([j for _, j in shared])]
        if anchors:
            out.extend(anchors)
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            ranges.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False))
    return sorted(out)


def _blocks(words: int, length: int) -> list[tuple[int, int]]:
    """Stretches of a text somewhat longer than the template, a quarter of it apart: a notice lies well inside one of them."""
    size, step = length + max(2, length // 2), max(1, length // 4)
    if words <= size:
        return [(0, words)]
    return [(s, s + size) for s in (*range(0, words - size, step), words - size)]


class Pieces:
    """Where runs of RUN words of the templates stand in a text."""

    def __init__(self, templates: dict[str, np.ndarray], vocabulary: int):
        rng = np.random.default_rng(17)
        self._mix = rng.integers(1, 1 << 62, RUN).astype(np.uint64) | np.uint64(1)
        self._mark = rng.integers(1, 1 << 62, vocabulary + 1).astype(np.uint64)
        grams: dict[int, list[tuple[str, int]]] = {}
        for name, words in templates.items():
            for at, gram in enumerate(self._grams(words).tolist()):
                grams.setdefault(gram, []).append((name, at))
        self._places = grams
        self._known = np.array(sorted(grams), np.uint64)

    def _grams(self, words: np.ndarray) -> np.ndarray:
        n = max(0, len(words) - RUN + 1)
        marks = self._mark[words]
        out = np.zeros(n, np.uint64)
        for k in range(RUN if n else 0):
            out += marks[k : k + n] * self._mix[k]
        return out

    def of(self, numbers: np.ndarray) -> dict[str, list[tuple[int, int, int]]]:
        """Per template the longest pieces: (first word in the text, first word in the template, length)."""
        inside = np.flatnonzero((numbers[: max(0, len(numbers) - RUN + 1)] != 0))
        grams = self._grams(numbers)[inside]
        hits = inside[np.isin(grams, self._known)]
        out: dict[str, dict[int, list[int]]] = {}
        for i in hits.tolist():
            gram = int(self._grams(numbers[i : i + RUN])[0])
            for name, at in self._places[gram]:
                runs = out.setdefault(name, {}).setdefault(i - at, [])  # along one diagonal
                if runs and runs[-1][0] + runs[-1][1] == i + RUN - 1:
                    runs[-1][1] += 1
                else:
                    runs.append([i, RUN])
        return {n: sorted((i, i - d, k) for d, runs in diagonals.items() for i, k in runs) for n, diagonals in out.items()}


def best_chain(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The pieces, rising in text and template, that cover most words together; of equal chains the one that starts last. Overlaps count once."""
    start, place, length = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    total, begun, before = length.copy(), start.copy(), np.full(len(pieces), -1)
    for j in range(1, len(pieces)):
        overlap = np.maximum(0, np.maximum(start[:j] + length[:j] - start[j], place[:j] + length[:j] - place[j]))
        gain = np.where((place[:j] <= place[j]) & (overlap < length[j]), total[:j] + length[j] - overlap, -1)
        best = gain.max()
        if best > total[j]:
            ties = np.flatnonzero(gain == best)
            before[j] = ties[np.argmax(begun[ties])]
            total[j], begun[j] = best, begun[before[j]]
    ends = np.flatnonzero(total == total.max())
    at, chain = int(ends[np.argmax(begun[ends])]), []
    while at >= 0:
        chain.append(pieces[at])
        at = int(before[at])
    return chain[::-1]


def _interrupted(numbers: np.ndarray, wanted: list[int], pieces: list[tuple[int, int, int]], coverage: float) -> list[tuple[float, int, int]]:
    """(-coverage, first word, last word) of notices in pieces: joined regions, aligned whole, as long as pieces enough are left."""
    found = []
    while pieces:
        least = coverage * len(wanted) - 1e-9
        if sum(k for _, _, k in pieces) < least:
            break
        chain = best_chain(pieces)
        words, at = [], []
        for i, _, k in chain:
            first = max(i, at[-1] + 1) if at else i
            if at and first > at[-1] + 1:  # something lies between: no word of the template
                words.append(0)
                at.append(first - 1)
            words.extend(numbers[first : i + k].tolist())
            at.extend(range(first, i + k))
        pairs = align(words, wanted)
        if len(pairs) < least:
            break
        found.append((-len(pairs) / len(wanted), at[pairs[0][0]], at[pairs[-1][0]]))
        used = set(chain)
        pieces = [p for p in pieces if p not in used]
    return found


def find_notices(
    numbers: np.ndarray, templates: dict[str, np.ndarray], vocabulary: int, coverage: float, pieces: Pieces | None = None
) -> list[tuple[str, float, int, int]]:
    """(name, coverage, first word, last word) of each template's occurrences in a text, given as word numbers; 0 is a word of no template.

    A stretch is aligned only if it has enough of the template's words at all, which no alignment can exceed. Pieces inside a place
    that was found whole are not looked at again.
    """
    out = []
    if not numbers.any():
        return out
    broken = (pieces or Pieces(templates, vocabulary)).of(numbers)
    for name, template in templates.items():
        member = np.zeros(vocabulary + 1, bool)
        member[template] = True
        running = np.concatenate([[0], np.cumsum(member[numbers])])
        if running[-1] < coverage * len(template) - 1e-9:
            continue
        spans = np.array(_blocks(len(numbers), len(template)))
        enough = np.flatnonzero(running[spans[:, 1]] - running[spans[:, 0]] >= coverage * len(template) - 1e-9)
        wanted, found = template.tolist(), []
        for first, last in spans[enough]:
            pairs = align(numbers[first:last].tolist(), wanted)
            share = len(pairs) / len(wanted)
            if share >= coverage - 1e-9:
                found.append((-share, int(first + pairs[0][0]), int(first + pairs[-1][0])))
        taken: list[tuple[int, int]] = []
        for share, first, last in sorted(set(found)):
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                out.append((name, -share, first, last))
        loose = [p for p in broken.get(name, ()) if all(p[0] + p[2] - 1 < a or p[0] > b for a, b in taken)]
        out.extend((name, -share, first, last) for share, first, last in _interrupted(numbers, wanted, loose, coverage))
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def _scanner(templates: dict[str, str], coverage: float):
    vocabulary: dict[str, int] = {}
    numbered = {n: np.array([vocabulary.setdefault(bare(w), len(vocabulary) + 1) for w in t.split()]) for n, t in templates.items()}
    pieces = Pieces(numbered, len(vocabulary))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(lambda words: np.array([vocabulary.get(bare(w), 0) for w in words], np.int32))
        for batch in batches:
            out = []
            for doc_id, missing, text in zip(batch["id"], batch["no_id"], batch["text"], strict=True):
                words = text.split()
                numbers = table.rows[places] if len(places := table.places(words)) else np.empty(0, np.int32)
                out.extend((None if missing else doc_id, *found) for found in find_notices(numbers, numbered, len(vocabulary), coverage, pieces))
            frame = pd.DataFrame(out, columns=["doc_id", "license", "coverage", "first_word", "last_word"])
            yield frame.astype({"doc_id": "Int64", "coverage": float, "first_word": "int64", "last_word": "int64"})

    return scan


MOST_TEMPLATES = 10_000


def read_templates(table: DataFrame) -> dict[str, str]:
    """Templates from a table (license, text), as many as MOST_TEMPLATES; of repeated names the smallest text counts, and those without a word are left out."""
    rows = table.filter("license IS NOT NULL AND text IS NOT NULL").groupBy("license").agg(F.min("text").alias("text")).limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return {r["license"]: r["text"] for r in sorted(rows) if r["text"].split()}


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word: each place of a whole text that covers at least that share of a template's words.

    Words are compared in lower case without punctuation at their ends, and counted from 0. A place is a stretch of half again the template's length at most, in which
    any words may differ; or any stretch, however long, in which the words covered stand in runs of five or more. Of overlapping places
    of one template in the first sense the best stays, then the first; places in the second sense use no run twice. `templates` are texts by name, as `read_templates`
    gives them. Null, empty and notice-free texts give no rows; repeated rows give repeated results, null ids stay null. Other columns are not read.
    """
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    schema = "doc_id long, license string, coverage double, first_word long, last_word long"
    return texts.mapInPandas(_scanner(templates, coverage), schema)
