"""Token ids by a word-level BPE file of `tokenizers` (lower case, ends of words marked).

White space parts words before any merge, so a word's ids never depend on its neighbours: each
distinct word is encoded once and remembered. Latin words go through a fast BPE over many words at
once; all others, and all words with a special token's string, through the library itself.
"""

from __future__ import annotations

import re

import numpy as np

from corpuslab.llm import vocab_files
from corpuslab.llm.common import kept

#: Words a worker remembers; when there are more, it starts again with none.
MEMORY = 400_000
END = "</w>"


class WordIds:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab, merges, added = vocab_files.load(path)
        first = {}
        for rank, (a, b) in enumerate(merges):
            first.setdefault(a + b, rank)
        order = sorted(first, key=lambda t: vocab[t])
        self.fast_ok = [first[t] for t in order] == sorted(first.values())  # ids follow the merges
        mark = b"\n"
        table = vocab_files.ranks({t: i for t, i in vocab.items() if (t, i) not in added}, END, mark)
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=table, special_tokens={})
        self.ends = np.zeros(max(table.values()) + 1, dtype=bool)
        self.ends[[i for b, i in table.items() if len(b) > 1 and b.endswith(mark)]] = True
        self.latin = re.compile("[!-~¡-įı-ɏ]+").fullmatch
        self.pieces = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+").findall
        self.words: dict[str, bytes] = {"": b""}

    def _learn(self, words: set[str]) -> None:
        plain, odd = [], []
        for w in words:
            (plain if self.fast_ok and "<|" not in w and self.latin(w) else odd).append(w)
        for w, e in zip(odd, self.library.encode_batch(odd, add_special_tokens=False) if odd else ()):
            self.words[w] = np.array(e.ids, dtype="<u4").tobytes()
        if not plain:
            return
        split = [[w] if w.isalpha() else self.pieces(w) for w in map(str.lower, plain)]
        flat = [p for ps in split for p in ps]
        ids = np.array(self.fast.encode_ordinary("\n".join(flat) + "\n"), dtype="<u4")
        closed = np.flatnonzero(self.ends[ids]) + 1  # where each piece's ids end
        at = closed[np.cumsum([len(ps) for ps in split]) - 1].tolist()
        raw, start = ids.tobytes(), 0
        for w, stop in zip(plain, at):
            self.words[w] = raw[4 * start:4 * stop]
            start = stop

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens. Null: none."""
        split = [t.replace("\n", " ").split(" ") if t else [""] for t in texts]
        met = set().union(*split)
        new = met.difference(self.words)
        if len(self.words) + len(new) > MEMORY:
            self.words = {"": b""}
            new = met - {""}
        self._learn(new)
        of = self.words.__getitem__
        return [b"".join(map(of, ws)) for ws in split]


def encoder(path: str) -> WordIds:
    return kept(("word ids", path), lambda: WordIds(path))
