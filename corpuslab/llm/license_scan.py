"""License notices in texts, by patience alignment.

A text is laid beside a notice's template: words that occur once in both are anchors, the longest run of
anchors in the same order stays, and the gaps between them are aligned the same way, after equal words at
their ends. The share of the template's words that found a partner is its coverage.

Texts are read in windows of one and a half templates that start every half template, so a notice lies whole
in some window, and several copies in several. A window is aligned only if it holds enough of the
template's words, counted with repeats, for the least coverage asked for; that loses no notice.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import row_map

#: Notices of public licenses, as their texts and headers have them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
}
#: Least share of a template's words that must be found.
COVERAGE = 0.8

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, given by their first numbers, whose second ones rise too."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def aligned(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in the text, place in the template) of words that patience alignment matches, in order."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c)}
        anchors = longest_rising([(i, place[w]) for i, w in enumerate(text[a:b], a) if ours[w] == 1 and theirs.get(w) == 1])
        found += anchors
        if anchors:
            for (p, q), (r, s) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
                if r - p > 1 and s - q > 1:
                    gaps.append((p + 1, r, q + 1, s))
    return sorted(found)


class Scanner:
    """Templates as words, with what a window must hold."""

    def __init__(self, notices: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = []
        for name, text in sorted(notices.items()):
            words = words_of(text)
            if words:
                self.templates.append((name, words, Counter(words), int(np.ceil(coverage * len(words) - 1e-9))))

    def scan(self, words: list[str]) -> list[tuple[str, int, int, float]]:
        """(license, first word, words spanned, coverage) of each notice, by place and license."""
        known, found = set(words), []
        for name, template, counts, least in self.templates:
            if sum(n for w, n in counts.items() if w in known) >= least:
                found += [(name, *f) for f in self._places(words, template, counts, least)]
        return sorted(found, key=lambda f: (f[1], f[0]))

    def _places(self, words, template, counts, least):
        step = max(1, len(template) // 2)
        size = len(template) + step
        marks = np.fromiter((w in counts for w in words), dtype=np.int64, count=len(words))
        before = np.concatenate([[0], np.cumsum(marks)])
        starts = np.arange(0, max(1, len(words) - size + step), step)
        ends = np.minimum(starts + size, len(words))
        spans = []
        for a, b in zip(starts[before[ends] - before[starts] >= least].tolist(), ends[before[ends] - before[starts] >= least].tolist()):
            here = Counter(words[a:b])
            if sum(min(n, here[w]) for w, n in counts.items()) < least:
                continue
            pairs = aligned(words[a:b], template)
            if len(pairs) >= least:
                first, last = a + pairs[0][0], a + pairs[-1][0]
                spans.append((first, last - first + 1, len(pairs) / len(template)))
        spans.sort(key=lambda s: (-s[2], s[1], s[0]))  # the best of those that overlap
        kept: list[tuple[int, int, float]] = []
        for s in spans:
            if all(s[0] >= k[0] + k[1] or k[0] >= s[0] + s[1] for k in kept):
                kept.append(s)
        return kept


def license_scan(docs: DataFrame, notices: dict[str, str] | None = None, coverage: float = COVERAGE, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """A row for each document: `doc_id`, `n_words` and `notices`, an array of (license, start, length, coverage), by place:
    where a notice starts in the text's words, how many words it spans, and the share of its template found.

    `notices`: template texts by license, a few dozen at most, as each task holds them all. Whole texts are
    scanned, row by row and without a shuffle. Case and punctuation do not count. Null and empty texts have
    no notices; repeated rows are scanned each; null ids stay null; an empty table stays empty; other
    columns are not looked at.
    """
    known = NOTICES if notices is None else notices

    def make():
        scanner = Scanner(known, coverage)

        def run(cols):
            split = [words_of(t) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"], "n_words": [len(ws) for ws in split],
                "notices": [[{"license": n, "start": s, "length": m, "coverage": c} for n, s, m, c in scanner.scan(ws)] for ws in split],
            }

        return run

    return row_map(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make,
        "doc_id long, n_words long, notices array<struct<license:string,start:long,length:long,coverage:double>>",
    )
