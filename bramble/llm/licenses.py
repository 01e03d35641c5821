"""License scans by patience alignment.

A text and a template are aligned on words that occur once in each: the longest
increasing run of such anchors is kept, and the gaps between anchors are aligned
in the same way.  Coverage is the share of the template's words that are
aligned.  An alignment is sought wherever a stretch of at most twice the
template's length holds enough of its words; a text that lacks them altogether
is passed over by a word-set test.  Where such stretches overlap they are aligned
together; if that finds less than the whole, for a copy nearby leaves no word that occurs once,
stretches within them are aligned each by itself.

Null and empty texts give no row; a repeated row gives its rows again; other
columns are ignored.  If several templates reach the threshold all are returned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import load, small_batches

# Public license notices and texts.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
WORD = re.compile(r"\w+(?:[.\-]\w+)*")
SCHEMA = "doc_id long, license string, coverage double, matched_words long, template_words long, first_word long, last_word long"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first member, whose second members increase."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        before[i] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            ends.append(i)
        else:
            tops[k], ends[k] = b, i
    run, i = [], ends[-1] if ends else -1
    while i >= 0:
        run.append(pairs[i])
        i = before[i]
    return run[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (text, template) in ascending order."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:  # equal ends need no anchor
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        wanted = Counter(template[c:d])
        once = {w: i for i, w in enumerate(template[c:d], c) if wanted[w] == 1}
        seen: dict[str, int] = {}
        for i in range(a, b):
            if text[i] in once:
                seen[text[i]] = -1 if text[i] in seen else i
        anchors = increasing(sorted((i, once[w]) for w, i in seen.items() if i >= 0))
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def windows(text: list[str], template: list[str], need: float) -> list[tuple[int, int]]:
    """Stretches of the text, at most twice as long as the template, that hold enough of its words: the longest to each end."""
    counts, width = Counter(template), 2 * len(template)
    at = [i for i, w in enumerate(text) if w in counts]
    out: list[tuple[int, int]] = []
    held: Counter = Counter()
    have = left = 0
    for i in at:
        have += held[text[i]] < counts[text[i]]
        held[text[i]] += 1
        while at[left] <= i - width:
            w = text[at[left]]
            held[w] -= 1
            have -= held[w] < counts[w]
            left += 1
        if have >= need:
            out.append((at[left], i + 1))
    return out


def joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping ones, in order of their starts and ends, as one."""
    out: list[tuple[int, int]] = []
    for a, b in stretches:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def places(text: list[str], template: list[str], need: float) -> list[tuple[int, int]]:
    """Stretches of the text, at most twice as long as the template, that hold enough of its words; overlapping ones are joined."""
    return joined(windows(text, template, need))


def shortest(text: list[str], template: list[str], need: float, first: int, end: int) -> list[tuple[int, int]]:
    """The shortest stretches of text[first:end] that hold enough of the template's words: none lies in another, or holds a second copy."""
    counts, width = Counter(template), 2 * len(template)
    at = [i for i in range(first, end) if text[i] in counts]
    out: list[tuple[int, int]] = []
    held: Counter = Counter()
    have = left = 0
    for i in at:
        have += held[text[i]] < counts[text[i]]
        held[text[i]] += 1
        while have >= need:
            w = text[at[left]]
            less = have - (held[w] <= counts[w])
            if less < need:
                if i + 1 - at[left] <= width:
                    if out and out[-1][0] == at[left]:
                        break
                    out.append((at[left], i + 1))
                break
            held[w] -= 1
            have = less
            left += 1
    return out


def closest(text: list[str], template: list[str], need: float) -> list[tuple[int, int]]:
    """The alignment that covers most of the template, the first of equals."""
    best: list[tuple[int, int]] = []

    def tried(a: int, b: int) -> None:
        nonlocal best
        if len(got := align(text[a:b], template)) > len(best):
            best = [(i + a, j) for i, j in got]

    m = len(template)
    for a, b in places(text, template, need):
        tried(a, b)
        if len(best) == m:
            return best
        if b - a <= m:
            continue
        # copies close together leave no anchors in what was joined
        for c, d in shortest(text, template, need, a, b):
            for e in sorted({d, min(b, max(d, c + m)), min(b, c + 2 * m)}):
                tried(c, e)
            for e in sorted({max(a, min(c, d - m)), max(a, d - 2 * m)} - {c}):
                tried(e, d)
            if len(best) == m:
                return best
    return best


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per document and template of which at least ``threshold`` is found, with the words it spans."""
    listed = {k: words(v) for k, v in (templates or TEMPLATES).items()}
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        sets = {k: (v, Counter(v)) for k, v in listed.items()}
        titles = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                have = words(text.as_py() or "")
                distinct = set(have)
                for k, (template, counts) in sets.items():
                    need = threshold * len(template)
                    if sum(n for w, n in counts.items() if w in distinct) < need:
                        continue
                    best = closest(have, template, need)
                    if best and len(best) >= need:
                        rows.append((name, k, len(best) / len(template), len(best), len(template), best[0][0], best[-1][0]))
            yield pa.RecordBatch.from_pylist([dict(zip(titles, r)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("template_words", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in all documents."""
    return scan(load(spark, sf_dir, "documents"))
