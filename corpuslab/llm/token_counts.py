"""Exact token counts at every prefix of a text.

Inside a pre-token, dynamic programming over its prefixes stores for each prefix the last token of
its encoding and the number of tokens: the encoding of a prefix of length i ends in the one token
t = piece[j:i] that may follow the last token of prefix j, which holds exactly when the bytes of
those two tokens encode to these two tokens. Counts of a text's prefixes are sums over pre-tokens.
Budgets and truncation read the stored counts, without encoding anything again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import vocab_files
from corpuslab.llm.common import kept, row_map

#: Words and token pairs a worker remembers; when there are more, it starts again with none.
MEMORY = 600_000


class PrefixCounter:
    """Counts for a byte-level `tokenizers` file with the usual contraction-aware splitting."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        vocab, _, added = vocab_files.load(path)
        special = {content for content, _ in added}
        self.ids = {b: i for b, i in vocab_files.ranks(vocab).items() if b.decode("utf-8", "replace") not in special}
        self.of = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.special = sorted(special, key=len, reverse=True)
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if special else None
        self.pattern = regex.compile(
            r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.encode = tiktoken.Encoding(
            "prefix", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={}
        )._encode_single_piece
        self.follows: dict[int, bool] = {}
        self.words: dict[str, int] = {}

    def _fits(self, a: int, b: int) -> bool:
        """Whether token `b` may follow token `a`, or begin a piece (`a` < 0)."""
        if len(self.follows) > MEMORY:
            self.follows.clear()
        said = self.encode(self.of[b] if a < 0 else self.of[a] + self.of[b])
        fits = self.follows[(a + 1) << 20 | b] = said == ([b] if a < 0 else [a, b])
        return fits

    def tables(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each pre-token with the token counts of its prefixes of 0, 1, … bytes (a list that the
        next step changes). In byte order, so that what a piece shares with the last one is kept."""
        ids, follows, longest = self.ids.get, self.follows.get, self.longest
        before, last, count = b"", [-1], [0]
        for piece in sorted(pieces):
            n, k = len(piece), 0
            for x, y in zip(before, piece):
                if x != y:
                    break
                k += 1
            del last[k + 1:], count[k + 1:]
            for i in range(k + 1, n + 1):
                for j in range(i - longest if i > longest else 0, i):
                    t = ids(piece[j:i])
                    if t is not None:
                        fits = follows((last[j] + 1) << 20 | t)
                        if fits is None:
                            fits = self._fits(last[j], t)
                        if fits:
                            last.append(t)
                            count.append(count[j] + 1)
                            break
            before = piece
            yield piece, count

    def byte_prefixes(self, piece: bytes) -> list[int]:
        return next(self.tables([piece]))[1]

    def _total(self, text: str) -> int:
        return sum(self.byte_prefixes(p.encode())[-1] for p in self.pattern.findall(text))

    def _learn(self, words: Iterable[str]) -> None:
        """Tokens of words with a space before them. Far below zero where a word's ends are white
        space or nothing, since pre-tokens then depend on what is around it."""
        split, find = {}, self.pattern.findall
        for w in words:
            if w and not w[0].isspace() and not w[-1].isspace():
                split[w] = find(" " + w)
            else:
                self.words[w] = -(1 << 60)
        pieces = {p.encode() for found in split.values() for p in found}
        total = {piece: count[-1] for piece, count in self.tables(pieces)}
        for w, found in split.items():
            self.words[w] = sum([total[p.encode()] for p in found])

    def _segments(self, text: str) -> list[str]:
        return self.split_special.split(text) if self.split_special and "<" in text else [text]

    def count(self, text: str | None) -> int:
        return self.count_many([text])[0]

    def count_many(self, texts: list[str | None]) -> list[int]:
        """Tokens of whole texts: the stored counts of their last prefixes."""
        split = [[part.split(" ") for part in self._segments(t or "")] for t in texts]
        met = set().union(*[words[1:] for parts in split for words in parts])
        new = met.difference(self.words)
        if len(self.words) + len(new) > MEMORY:
            self.words.clear()
            new = met
        self._learn(new)
        count, out = self.words.__getitem__, []
        for parts in split:
            total = len(parts) - 1
            for words in parts:
                first = words[0]
                n = sum(map(count, words[1:]))
                if n < 0 or first and first[-1].isspace():
                    total += self._total(" ".join(words))
                else:
                    total += n + self._total(first)
            out.append(total)
        return out

    def prefixes(self, text: str | None) -> np.ndarray:
        """Exact token counts of the prefixes of 0, 1, … characters of a text."""
        text = text or ""
        out, base, at = np.zeros(len(text) + 1, dtype=np.int64), 0, 0
        found = list(self.split_special.finditer(text)) if self.split_special else []
        for start, end in [(m.start(), m.end()) for m in found] + [(len(text), None)]:
            stop = len(text) if end is None else end - 1  # a special string that is not complete is plain text
            counts = self._plain_prefixes(text[at:stop])
            out[at:stop + 1] = base + counts
            if end is not None:
                base += int(counts[start - at]) + 1
                out[end] = base
                at = end
        return out

    def _plain_prefixes(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, dtype=np.int64)
        base = 0
        run_start, run_base = 0, 0  # of the white space that a piece ends
        blank = False
        for m in self.pattern.finditer(text):
            s, e = m.span()
            piece = m.group()
            if not blank:
                run_start, run_base = s, base
            counts = self.byte_prefixes(piece.encode())
            if piece[0] == "'" and piece[1:].isalpha():  # its beginnings are split otherwise
                tally = [self._total(piece[:k]) for k in range(1, len(piece))] + [counts[-1]]
            elif piece.isascii():
                tally = counts[1:]
            else:
                tally = [counts[b] for b in np.cumsum([len(c.encode()) for c in piece])]
            out[s + 1:e + 1] = base + np.asarray(tally)
            if blank and piece[0].isspace():  # a text that ends here ends in one run
                out[s + 1] = run_base + self.byte_prefixes(text[run_start:s + 1].encode())[-1]
            base += tally[-1]
            blank = piece.isspace()
        return out

    def cut(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1]) if budget >= 0 else 0


def counter(path: str) -> PrefixCounter:
    return kept(("prefix counts", path), lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `n_bytes` (UTF-8), `n_tokens`, `over_limit` for each row's whole text.

    Null and empty texts have no bytes and no tokens. Strings of special tokens in a text count as
    those tokens, as the library does by default. Repeated rows and ids come out as they come in;
    a null id stays null; an empty table stays empty. There is no shuffle.
    """

    def make():
        tokens = counter(path)

        def run(cols):
            n = tokens.count_many(cols["text"])
            return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) if t else 0 for t in cols["text"]],
                    "n_tokens": n, "over_limit": [k > limit for k in n]}

        return run

    return row_map(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )


def budget_cuts(docs: DataFrame, path: str, budgets: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id` and `cuts`: for each budget the characters of the longest prefix within it."""

    def make():
        tokens = counter(path)

        def cuts(t):
            stored = tokens.prefixes(t)
            return [int(np.flatnonzero(stored <= b)[-1]) for b in budgets]

        return lambda cols: {"doc_id": cols["doc_id"], "cuts": [cuts(t) for t in cols["text"]]}

    if min(budgets) < 0:
        raise ValueError("a budget is zero or more")
    return row_map(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make,
        "doc_id long, cuts array<long>",
    )
