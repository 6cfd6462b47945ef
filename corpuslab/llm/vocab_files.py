"""Reading public tokenizer files, whose path is a parameter."""

from __future__ import annotations

import json


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 stands for
    itself, the others follow from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> tuple[dict[str, int], list[list[str]], list[tuple[str, int]]]:
    """Vocabulary, merges and added tokens of a `tokenizers` file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return spec["model"]["vocab"], merges, [(t["content"], t["id"]) for t in spec["added_tokens"]]


def ranks(vocab: dict[str, int], end: str = "", mark: bytes = b"") -> dict[bytes, int]:
    """Bytes of each token and its id; the suffix `end` is written as the byte `mark`."""
    letters = byte_letters()
    out = {}
    for token, i in vocab.items():
        tail = mark if end and token.endswith(end) else b""
        body = token[: -len(end)] if tail else token
        if all(c in letters for c in body):
            out[bytes(letters[c] for c in body) + tail] = i
    return out
