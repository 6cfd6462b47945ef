"""License notices by patience alignment against a plain restatement and planted copies."""

import random

import pytest

from corpuslab.llm import license_scan
from corpuslab.llm.license_scan import NOTICES, Scanner, aligned, longest_rising, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, notices string, start int, length int, license string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "n", 2, 3, "l") for i, t in rows], DOCS)


def longest_by_hand(pairs):
    best = [[]] * (len(pairs) + 1)
    for i in range(len(pairs) - 1, -1, -1):
        best[i] = max(([pairs[i]] + next((best[j] for j in sorted(range(i + 1, len(pairs)), key=lambda j: -len(best[j])) if pairs[j][1] > pairs[i][1]), []),), key=len)
    return max(map(len, best), default=0)


def aligned_by_hand(text, template, a=0, c=0):
    """The same alignment, written down as it is told."""
    if not text or not template:
        return []
    if text[0] == template[0]:
        return [(a, c)] + aligned_by_hand(text[1:], template[1:], a + 1, c + 1)
    if text[-1] == template[-1]:
        return aligned_by_hand(text[:-1], template[:-1], a, c) + [(a + len(text) - 1, c + len(template) - 1)]
    anchors = [(i, template.index(w)) for i, w in enumerate(text) if text.count(w) == 1 and template.count(w) == 1]
    run = longest_rising(anchors)
    if not run:
        return []
    out, p, q = [], 0, 0
    for i, j in [*run, (len(text), len(template))]:
        out += aligned_by_hand(text[p:i], template[q:j], a + p, c + q)
        if i < len(text) or j < len(template):
            out.append((a + i, c + j))
        p, q = i + 1, j + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_alignment_by_hand(seed):
    rng = random.Random(seed)
    for _ in range(600):
        letters = "abcdefghij"[:rng.choice([2, 4, 10])]
        template = [rng.choice(letters) for _ in range(rng.randint(0, 10))]
        text = [w for w in template if rng.random() < 0.8] if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            text.insert(rng.randint(0, len(text)), rng.choice(letters + "z"))
        got = aligned(text, template)
        assert got == aligned_by_hand(text, template)
        assert all(text[i] == template[j] for i, j in got) and got == sorted(got) and [j for _, j in got] == sorted(j for _, j in got)


@pytest.mark.parametrize("seed", range(3))
def test_longest_rising(seed):
    rng = random.Random(seed)
    for _ in range(200):
        places = rng.sample(range(12), rng.randint(0, 10))
        pairs = list(enumerate(places))
        run = longest_rising(pairs)
        assert len(run) == longest_by_hand(pairs) and [b for _, b in run] == sorted(b for _, b in run)


@pytest.mark.parametrize("seed", range(4))
def test_planted_notices_are_found(seed):
    rng, scanner = random.Random(seed), Scanner(NOTICES, 0.8)
    for name, notice in NOTICES.items():
        words = words_of(notice)
        gone = int(0.1 * len(words))
        kept = sorted(rng.sample(range(len(words)), len(words) - gone))
        hurt = [words[i] for i in kept]
        filler = lambda: [rng.choice(["the", "of", "a", "license", "version", "x1", "x2", "x3"]) for _ in range(rng.randint(0, 400))]
        before, between = filler(), filler()
        text = before + words + between + hurt + filler()
        places = [(s, n) for found, s, n, c in scanner.scan(text) if found == name]
        for start, length in ((len(before), len(words)), (len(before) + len(words) + len(between), len(hurt))):
            assert any(s < start + length and start < s + n for s, n in places), (name, places, start)
    assert scanner.scan(["the", "license", "of", "version", "under"] * 500) == []


def test_copies_one_after_another():
    words = words_of(NOTICES["MIT"])
    found = Scanner({"MIT": NOTICES["MIT"]}, 0.8).scan(words * 6)
    assert len(found) >= 4 and all(c >= 0.8 for *_, c in found)


def test_scanned_documents(spark):
    notice = NOTICES["MIT"]
    rows = [(1, f"Some words. {notice}\nMore."), (1, f"Some words. {notice}\nMore."), (2, None), (3, ""), (None, notice.upper()),
            (4, "plain " * 20_000), (5, NOTICES["GPL-3.0"] + " " + NOTICES["Apache-2.0"])]
    got = {(r["doc_id"], r["n_words"]): [tuple(n) for n in r["notices"]] for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == {
        (1, 8): [("MIT", 2, 5, 1.0)], (2, 0): [], (3, 0): [], (None, 5): [("MIT", 0, 5, 1.0)], (4, 20_000): [],
        (5, 20): [("GPL-3.0", 0, 12, 1.0), ("Apache-2.0", 12, 8, 1.0)],
    }
    assert license_scan.license_scan(frame(spark, [])).collect() == []
