"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product of its letters'
vectors, each permuted (rolled) by its distance from the trigram's end; word boundaries are a
letter of their own. A text's profile is the sum over all its trigrams; a language's prototype is
the sum of the unit profiles of its training texts. A text gets the language whose prototype has
the largest cosine with its profile.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import crc_fold, kept, row_map

#: Components of a hypervector.
DIMENSIONS = 512
#: Letters told apart: 0 is the boundary, a-z are 1-26, all others share the rest by code point.
SYMBOLS = 128
#: Trigram vectors that a worker keeps; others are bound anew each time.
KEPT = 60_000
#: Texts from which a language's prototype is learned: about this many, chosen by a hash of the id
#: (all where there are fewer).
SAMPLE = 3_000
#: Every how many'th fold is held out of learning.
FOLDS = 5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Symbol of each code point."""
    points = range(0x110000)
    table = np.fromiter((chr(c).isalpha() for c in points), dtype=bool, count=0x110000)
    out = np.where(table, 27 + np.arange(0x110000) % (SYMBOLS - 27), 0).astype(np.uint8)
    out[ord("a"):ord("z") + 1] = np.arange(1, 27)
    return out


class Binder:
    """Trigram codes of texts and the bound vectors of codes."""

    def __init__(self):
        vectors = np.random.default_rng(20_240_601).choice([-1, 1], size=(SYMBOLS, DIMENSIONS)).astype(np.int8)
        self.last, self.middle, self.first = vectors, np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
        self.place = np.full(SYMBOLS**3, -1, dtype=np.int32)
        self.rows = np.empty((KEPT, DIMENSIONS), dtype=np.float32)
        self.used = 0

    def codes(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigram codes of a text and how often each occurs. None without a letter."""
        none = np.zeros(0, dtype=np.int64)
        if not text:
            return none, none
        s = _letters()[np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)]
        s = np.concatenate([[0], s, [0]])
        s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]].astype(np.int32)  # one boundary in a row
        if len(s) < 3:
            return none, none
        return np.unique(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], return_counts=True)

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        a, rest = np.divmod(codes, SYMBOLS**2)
        b, c = np.divmod(rest, SYMBOLS)
        return self.first[a] * self.middle[b] * self.last[c]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code."""
        at = self.place[codes]
        new = codes[at < 0]
        if len(new):
            room = new[: KEPT - self.used]
            self.rows[self.used:self.used + len(room)] = self._bind(room)
            self.place[room] = np.arange(self.used, self.used + len(room))
            self.used += len(room)
            at = self.place[codes]
        out = self.rows[at]
        if len(new) and (at < 0).any():
            out[at < 0] = self._bind(codes[at < 0])
        return out

    def profile(self, text: str | None) -> np.ndarray | None:
        """Bundle of all trigrams of a text, of length one. None without a letter."""
        codes, counts = self.codes(text)
        if not len(codes):
            return None
        bundle = counts.astype(np.float32) @ self.vectors(codes)
        size = float(np.sqrt((bundle * bundle).sum()))
        return bundle / size if size else bundle


def binder() -> Binder:
    return kept("language", Binder)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes (one row each, of length one).

    Learns from rows that are not held out and have a language, about `sample` of each language by
    a hash of the id; texts without letters teach nothing. What reaches the driver is one vector
    for each language.
    """
    known = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & (crc_fold("doc_id", FOLDS) != 0))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((0, DIMENSIONS), dtype=np.float32)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) / 1_000_000
    chosen = known.where(draw < share[F.col("lang")]).select("lang", "text")

    def make():
        bind = binder()

        def run(cols):
            sums: dict[str, np.ndarray] = {}
            for k, t in zip(cols["lang"], cols["text"]):
                p = bind.profile(t)
                if p is not None:
                    sums[k] = sums.get(k, 0) + p.astype(np.float64)
            return {"lang": list(sums), "bundle": list(sums.values())}

        return run

    parts = row_map(chosen, make, "lang string, bundle array<double>")
    summed = parts.select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i").agg(
        F.round(F.sum("v"), 6).alias("v")  # the order of additions leaves no trace
    )
    found: dict[str, np.ndarray] = {}
    for k, i, v in summed.collect():
        found.setdefault(k, np.zeros(DIMENSIONS))[i] = v
    names = sorted(found)
    rows = np.array([found[k] / max(np.linalg.norm(found[k]), 1e-12) for k in names], dtype=np.float32)
    return names, rows.reshape(len(names), DIMENSIONS)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, keep: list[str] | None = None,
            doc_id: str = "doc_id", text: str = "text",
            added: tuple[str, str, str] = ("lang_pred", "score", "has_letters")) -> DataFrame:
    """`doc_id`, `lang_pred`, `score` (the cosine, 0 where it is negative), `has_letters` of each row's
    whole text.

    `und` with score 0: text is null or has no letter, or nothing was learned. Ties go to the first
    name. Repeated rows are judged each; null ids stay null; an empty table stays empty. `keep`:
    columns of `docs` to carry along in place of the id. `added`: the names of the three new columns,
    none of which may be one of those.
    """
    if keep is None:
        source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        return _mapped(source, names, prototypes, ["doc_id"], "doc_id long", added)
    return _mapped(docs.select(*keep), names, prototypes, keep,
                   ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), added)


def _mapped(source: DataFrame, names: list[str], prototypes: np.ndarray, kept: list[str], ddl: str,
            added: tuple[str, str, str]) -> DataFrame:
    def make():
        bind = binder()

        def best(text):
            p = bind.profile(text)
            if p is None or not names:
                return "und", 0.0, p is not None
            cosines = prototypes @ p
            i = int(cosines.argmax())
            return names[i], min(1.0, max(0.0, float(cosines[i]))), True

        def run(cols):
            judged = [best(t) for t in cols["text"]]
            return {k: cols[k] for k in kept} | {n: [j[i] for j in judged] for i, n in enumerate(added)}

        return run

    return row_map(source, make, ddl + ", `{}` string, `{}` double, `{}` boolean".format(*added))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns and predicts: `doc_id`, `held_out`, `lang_pred`, `score` for every row."""
    names, prototypes = learn(docs, doc_id, text, lang)
    return predict(docs, names, prototypes, doc_id=doc_id, text=text).select(
        "doc_id", (crc_fold("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", "score"
    )
