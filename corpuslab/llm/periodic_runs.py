"""Runs of repeated word sequences, by a suffix automaton with link-cut access.

A run is a stretch of words with a smallest period q, at least twice as long, that no neighbouring
word extends. The automaton's suffix links form a tree whose path from a prefix's state to the root
holds all suffixes of that prefix. Each word's access recolours that path with its own place, so a
path falls into segments of suffixes with the same last end before. If suffixes of lengths lo+1 to hi
last ended d words earlier and lo < d <= hi, the text has a square of period d here whose periodic
stretch reaches back hi + d words; stretches with the same start and period are one run, which ends
at the last such place. Splay trees hold the segments, so all accesses together change about
n log n of them.

A run of at least m words has an m/2-gram in its first half that occurs again one period later. So only
stretches covered by such recurring grams are searched, each by itself; what lies between holds no run.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import row_map

#: Fewest words of a run.
MIN_LENGTH = 12

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Lengths and suffix links of a suffix automaton's states, and the state of each prefix.
    State 1 is the root; its link is 0."""
    length, link, follow = [0, 0], [0, 0], [{}, {}]
    last, states = 1, []
    for i, w in enumerate(words):
        state = len(length)
        length.append(i + 1)
        link.append(1)
        follow.append({})
        p = last
        while p and w not in follow[p]:
            follow[p][w] = state
            p = link[p]
        if p:
            q = follow[p][w]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                follow.append(follow[q].copy())
                while p and follow[p].get(w) == q:
                    follow[p][w] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
        states.append(state)
    return length, link, states


class Paths:
    """Segments of root paths, one splay tree each, ordered by depth. `seen` of a splay tree's root is
    the place that last accessed the segment, 0 for none."""

    def __init__(self, link: list[int]):
        self.up = [0 if p == 1 else p for p in link]  # the tree's root is on no path
        self.left, self.right = [0] * len(link), [0] * len(link)
        self.seen = [0] * len(link)

    def splay(self, x: int) -> None:
        """Makes `x` the root of its splay tree."""
        up, left, right, seen = self.up, self.left, self.right, self.seen
        while True:
            p = up[x]
            if not p:
                return
            if left[p] == x:
                side = True
            elif right[p] == x:
                side = False
            else:
                return
            g = up[p]
            far = 0 if not g else 1 if left[g] == p else 2 if right[g] == p else 0
            if far and (far == 1) == side:  # the same side twice: the parent turns first
                self.turn(p, g, side)
                self.turn(x, p, side)
                if not self.inner(x):
                    seen[x] = seen[g]
            elif far:
                self.turn(x, p, side)
                self.turn(x, g, far == 1)
                if not self.inner(x):
                    seen[x] = seen[g]
            else:
                self.turn(x, p, side)
                seen[x] = seen[p]

    def inner(self, x: int) -> bool:
        p = self.up[x]
        return p != 0 and (self.left[p] == x or self.right[p] == x)

    def turn(self, x: int, p: int, side: bool) -> None:
        """Rotates `x` over its parent; `side`: it is the left child."""
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if side:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child:
            up[child] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, state: int, place: int, length: list[int]) -> list[tuple[int, int, int]]:
        """Recolours the path to `state` with `place`. Its segments until now, deepest first:
        (last place, length above it, length of its deepest state on the path)."""
        segments, below, x = [], 0, state
        up, right, seen = self.up, self.right, self.seen
        while x:
            self.splay(x)
            if seen[x]:
                segments.append((seen[x], length[up[x]] if up[x] else 0, length[x]))
            cut = right[x]
            if cut:
                seen[cut] = seen[x]
            right[x] = below
            below, x = x, up[x]
        seen[below] = place
        return segments


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least two periods, by start and period."""
    length, link, states = automaton(words)
    paths, ends = Paths(link), {}
    for i, state in enumerate(states, 1):
        for place, above, deepest in paths.access(state, i, length):
            period = i - place
            if above < period <= deepest:
                ends[i - deepest - period, period] = i
    return sorted((start, end - start, period) for (start, period), end in ends.items())


def _covered(keys: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs more than once (or shares its hash with another)."""
    n = len(keys) - k + 1
    grams = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + keys[i:i + n]
    order = np.argsort(grams, kind="stable")
    same = np.concatenate([[False], grams[order[1:]] == grams[order[:-1]], [False]])
    twice = np.zeros(n, dtype=np.int64)
    twice[order] = same[1:] | same[:-1]
    before = np.concatenate([[0], np.cumsum(twice)])
    at = np.arange(len(keys))
    return before[np.minimum(at, n - 1) + 1] > before[np.maximum(at - k + 1, 0)]


def stretches(keys: np.ndarray, least: int, start: int = 0) -> list[tuple[int, int]]:
    """Parts (from, to) of a text that hold all its runs of `least` words: each is covered by grams
    that recur within it."""
    if len(keys) < least:
        return []
    covered = _covered(keys, (least + 1) // 2)
    if covered.all():
        return [(start, start + len(keys))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return [
        part for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least
        for part in stretches(keys[a:b], least, start + a)
    ]


def text_runs(words: list[str], least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `least` words, by start and period."""
    if len(words) < least:
        return []
    keys = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    found = []
    for a, b in stretches(keys, least):
        found += [(a + s, n, q) for s, n, q in runs_of(words[a:b]) if n >= least]
    return found


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """Words that are in no run after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: `doc_id`, `n_words`, `runs` (array of start, length, period, by start and
    period) and `collapsed` (its words without repeats, joined by one space).

    Whole texts are searched, row by row and without a shuffle; a worker holds the automaton of one
    stretch, some hundred bytes a word. Null and empty texts have no words, no runs and an empty
    `collapsed`. Repeated rows are searched each; null ids stay null; an empty table stays empty;
    other columns are not looked at.
    """
    def make():
        def run(cols):
            split = [_WORD.findall(t) if t else [] for t in cols["text"]]
            runs = [text_runs(ws, least) for ws in split]
            return {
                "doc_id": cols["doc_id"], "n_words": [len(ws) for ws in split],
                "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs],
                "collapsed": [" ".join(collapsed(ws, r)) for ws, r in zip(split, runs)],
            }

        return run

    return row_map(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make,
        "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
    )
