"""Per-segment statistics: the one table every n-gram score is rolled up from.

A segment's texts live in one row, so its n-gram overlaps are array expressions on that row.
Nothing is exploded and nothing is shuffled until the small numeric counts are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.config import BLEU_ORDER, OTHER_WEIGHT
from corpuslab.functions.arrays import gram_keys, numbered, overlap_size
from corpuslab.functions.text import space_tokens, strip


def ref_tokens(refs: Column) -> Column:
    return F.transform(refs, space_tokens)


def clipped_overlap(hyp: str, refs: str, n: int, single: bool = False) -> Column:
    """Matches of the hypothesis, each n-gram counted at most as often as in its best reference.

    Names token-array columns; `refs` is an array of token arrays, or one of them if `single`.
    """
    if single:
        return F.expr(f"cast({overlap_size(gram_keys(hyp, n), gram_keys(refs, n))} as bigint)")
    best = f"array_distinct(flatten(transform({refs}, r_ -> {numbered(gram_keys('r_', n))})))"
    return F.expr(f"cast(size(array_intersect({numbered(gram_keys(hyp, n))}, {best})) as bigint)")


def possible(length: Column, n: int) -> Column:
    return F.greatest(length - (n - 1), F.lit(0)).cast("bigint")


def closest_length(ref_lens: Column, hyp_len: Column) -> Column:
    """Reference length nearest to the hypothesis, the shorter one on ties."""
    ranked = F.transform(
        ref_lens, lambda r: F.struct(F.abs(r - hyp_len).alias("gap"), r.alias("len"))
    )
    return F.array_min(ranked).getField("len")


def keyword_mask(tokens: Column, keywords: list[str]) -> Column:
    words = F.array(*[F.lit(k) for k in keywords])
    return F.filter(tokens, lambda t: F.array_contains(words, t))


def token_weight(token: Column, keywords: list[str], keyword_weight: float = 1.0,
                 other_weight: float = OTHER_WEIGHT) -> Column:
    return F.when(token.isin(list(keywords)), keyword_weight).otherwise(other_weight)


def recall_terms(hyp: str, refs: str, keywords: list[str], orders: int = BLEU_ORDER) -> Column:
    """Per order a struct (num, den) of keyword-weighted recall, summed over references.

    The single words are weighted by the keyword list, longer n-grams are not; each reference
    counts at least 1 in the denominator.
    """
    words = ", ".join("'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'" for k in keywords)

    def weigh(tokens: str) -> str:
        heavy = f"size(filter(t_, y_ -> array_contains(array({words}), y_)))"
        return (
            f"get(transform(array({tokens}), t_ -> cast({heavy} as double)"
            f" + {OTHER_WEIGHT}D * (size(t_) - {heavy})), 0)"
        )

    def order(n: int) -> str:
        shared = f"array_intersect({numbered(gram_keys('q_', n))}, {numbered(gram_keys(hyp, n))})"
        if n == 1:
            plain = f"transform({shared}, z_ -> substring_index(z_, '\\u001f\\u001f', 1))"
            num, den = weigh(plain), weigh("q_")
        else:
            num, den = f"cast(size({shared}) as double)", f"cast(size(q_) - {n - 1} as double)"
        per_ref = f"transform({refs}, q_ -> struct({num} as num, greatest({den}, 1D) as den))"
        return (
            f"aggregate({per_ref}, struct(0D as num, 0D as den), "
            "(a_, b_) -> struct(a_.num + b_.num as num, a_.den + b_.den as den))"
        )

    return F.expr(f"array({', '.join(order(n) for n in range(1, orders + 1))})")


def single_recall_terms(hyp: str, ref: str, keywords: list[str]) -> Column:
    """The same for one reference, on a row that has its overlaps `m2…` already."""
    first = F.get(recall_terms(hyp, f"array({ref})", keywords, orders=1), F.lit(0))
    rest = [
        F.struct(
            F.col(f"m{n}").cast("double").alias("num"),
            F.greatest(possible(F.size(ref), n), F.lit(1)).cast("double").alias("den"),
        )
        for n in range(2, BLEU_ORDER + 1)
    ]
    return F.array(first, *rest)


def seg_stats(segments: DataFrame, hyp: str = "hyp", refs: str | None = None, ref: str = "ref",
              max_order: int = BLEU_ORDER, keywords: list[str] | None = None,
              text: bool = False) -> DataFrame:
    """One row per segment: lengths, clipped matches `m1…` and, with keywords, recall terms.

    `refs` names an array column of references; else `ref` holds the only one. Columns other
    than the texts pass through.
    """
    ref_array = F.col(refs) if refs else F.array(F.col(ref))
    first_ref = F.get(F.col(refs), F.lit(0)) if refs else F.col(ref)
    texts = {hyp, refs or ref}
    keep = [c for c in segments.columns if text or c not in texts]
    tok = segments.select(
        *keep,
        (strip(F.col(hyp)) == strip(first_ref)).alias("exact"),
        space_tokens(F.col(hyp)).alias("hyp_tok"),
        (ref_tokens(ref_array) if refs else space_tokens(F.col(ref))).alias("ref_tok"),
    )
    hyp_len = F.size("hyp_tok").cast("bigint")
    if refs:
        lens = F.transform("ref_tok", lambda r: F.size(r).cast("bigint"))
        short, close, count = F.array_min(lens), closest_length(lens, hyp_len), F.size("ref_tok")
    else:
        short = close = F.size("ref_tok").cast("bigint")
        count = F.lit(1)
    overlaps = [
        clipped_overlap("hyp_tok", "ref_tok", n, single=refs is None).alias(f"m{n}")
        for n in range(1, max_order + 1)
    ]
    counted = tok.select(
        *keep, "exact", hyp_len.alias("hyp_len"), short.alias("short_ref_len"),
        close.alias("close_ref_len"), count.cast("bigint").alias("ref_count"), *overlaps,
        *(["hyp_tok", "ref_tok"] if keywords is not None else []),
    )
    if keywords is None:
        return counted
    terms = recall_terms if refs else single_recall_terms
    return counted.withColumn("recall", terms("hyp_tok", "ref_tok", keywords)).drop("hyp_tok", "ref_tok")
