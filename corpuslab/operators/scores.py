"""Scores: roll-ups of the segment statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.config import BLEU_ORDER
from corpuslab.functions.bleu import (
    Counts,
    Smoother,
    brevity_penalty,
    plain_bleu,
    smoothed_bleu,
)
from corpuslab.operators.segments import possible


def _matches(order: int) -> Column:
    return F.array(*[F.col(f"m{n}") for n in range(1, order + 1)])


def _possible(order: int) -> Column:
    return F.array(*[possible(F.col("hyp_len"), n) for n in range(1, order + 1)])


def _at_least_one(order: int) -> Column:
    return F.array(
        *[F.greatest(possible(F.col("hyp_len"), n), F.lit(1)) for n in range(1, order + 1)]
    )


def corpus_sums(stats: DataFrame, by: list[str], order: int = BLEU_ORDER) -> DataFrame:
    """Additive counts per group; partial sums are formed before the shuffle."""
    sums = [F.sum(F.col(f"m{n}")).alias(f"m{n}") for n in range(1, order + 1)]
    sums += [F.sum(possible(F.col("hyp_len"), n)).alias(f"p{n}") for n in range(1, order + 1)]
    sums += [
        F.sum(F.greatest(possible(F.col("hyp_len"), n), F.lit(1))).alias(f"d{n}")
        for n in range(1, order + 1)
    ]
    if "recall" in stats.columns:
        for i in range(BLEU_ORDER):
            term = F.get("recall", F.lit(i))
            sums += [F.sum(term.getField("num")).alias(f"rn{i}"), F.sum(term.getField("den")).alias(f"rd{i}")]
    return stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("exact").cast("bigint")).alias("hits"),
        F.sum("hyp_len").alias("hyp_len"),
        F.sum("short_ref_len").alias("short_ref_len"),
        F.sum("close_ref_len").alias("close_ref_len"),
        *sums,
    )


def _summed(prefix: str, order: int) -> Column:
    return F.array(*[F.col(f"{prefix}{n}") for n in range(1, order + 1)])


def exact_match(stats: DataFrame, by: list[str]) -> DataFrame:
    """Share of segments that equal their reference, in per cent."""
    return stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("exact").cast("bigint")).alias("hits"),
        (F.avg(F.col("exact").cast("double")) * 100).alias("exact_match"),
    )


def bleu_from_sums(sums: DataFrame, smooth: bool = True, order: int = BLEU_ORDER) -> Column:
    return plain_bleu(_summed("m", order), _summed("p", order), F.col("hyp_len"),
                      F.col("short_ref_len"), smooth)


def corpus_bleu(stats: DataFrame, by: list[str], smooth: bool = True,
                order: int = BLEU_ORDER) -> DataFrame:
    sums = corpus_sums(stats, by, order)
    return sums.select(*by, bleu_from_sums(sums, smooth, order).alias("bleu"))


def segment_bleu(smooth: bool = True, order: int = BLEU_ORDER) -> Column:
    """Score of one segment, on a row of segment statistics."""
    return plain_bleu(_matches(order), _possible(order), F.col("hyp_len"),
                      F.col("short_ref_len"), smooth)


def nbleu_from_sums(smoothing: str | Smoother = "m1", weights: list[float] | None = None,
                    auto_reweigh: bool = False) -> Column:
    order = len(weights) if weights else BLEU_ORDER
    counts = Counts(_summed("m", order), _summed("d", order), F.col("hyp_len"))
    return smoothed_bleu(counts, F.col("close_ref_len"), smoothing, weights, auto_reweigh)


def corpus_nbleu(stats: DataFrame, by: list[str], smoothing: str | Smoother = "m1",
                 weights: list[float] | None = None, auto_reweigh: bool = False) -> DataFrame:
    sums = corpus_sums(stats, by, len(weights) if weights else BLEU_ORDER)
    return sums.select(*by, nbleu_from_sums(smoothing, weights, auto_reweigh).alias("bleu"))


def segment_counts(order: int = BLEU_ORDER, with_next: bool = False) -> Counts:
    beyond = None
    if with_next:
        beyond = F.col(f"m{order + 1}").cast("double") / F.greatest(
            possible(F.col("hyp_len"), order + 1), F.lit(1)
        )
    return Counts(_matches(order), _at_least_one(order), F.col("hyp_len"), beyond)


def segment_nbleu(smoothing: str | Smoother = "m1", weights: list[float] | None = None,
                  auto_reweigh: bool = False) -> Column:
    """Score of one segment; smoothers m5, m7 and a caller's own read the order above the last one."""
    order = len(weights) if weights else BLEU_ORDER
    counts = segment_counts(order, with_next=callable(smoothing) or smoothing in ("m5", "m7"))
    return smoothed_bleu(counts, F.col("close_ref_len"), smoothing, weights, auto_reweigh)


def modified_precision(stats: DataFrame, keys: list[str], order: int = BLEU_ORDER) -> DataFrame:
    """Numerator and denominator per segment and order, one row each."""
    per_order = F.array(*[
        F.struct(
            F.lit(n).cast("bigint").alias("n"),
            F.col(f"m{n}").alias("num"),
            F.greatest(possible(F.col("hyp_len"), n), F.lit(1)).alias("den"),
        )
        for n in range(1, order + 1)
    ])
    return stats.select(*keys, F.inline(per_order))


def recall_from_sums(smoothing: str = "m1", strict_ref_len: bool = False) -> Column:
    """Keyword-weighted recall on a row of sums.

    The length penalty that published scores use compares with two tokens per reference
    whatever the text; `strict_ref_len` uses the closest reference length instead.
    """
    if smoothing not in ("m1", "m2"):
        raise ValueError("keyword-weighted recall is defined for smoothing m1 and m2 only")
    ref_len = F.col("close_ref_len") if strict_ref_len else F.col("n") * 2
    counts = Counts(
        F.array(*[F.col(f"rn{i}") for i in range(BLEU_ORDER)]),
        F.array(*[F.col(f"rd{i}") for i in range(BLEU_ORDER)]),
        F.col("hyp_len"),
    )
    return smoothed_bleu(counts, ref_len, smoothing)


def weighted_recall(stats: DataFrame, by: list[str], smoothing: str = "m1",
                    strict_ref_len: bool = False) -> DataFrame:
    score = recall_from_sums(smoothing, strict_ref_len)
    return corpus_sums(stats, by).select(*by, score.alias("weighted_recall"))


def segment_weighted_recall(smoothing: str = "m1", strict_ref_len: bool = False) -> Column:
    counts = Counts(
        F.transform("recall", lambda r: r.getField("num")),
        F.transform("recall", lambda r: r.getField("den")),
        F.col("hyp_len"),
    )
    ref_len = F.col("close_ref_len") if strict_ref_len else F.lit(2)
    return smoothed_bleu(counts, ref_len, smoothing)


def penalty_table(stats: DataFrame, keys: list[str]) -> DataFrame:
    return stats.select(
        *keys,
        F.col("close_ref_len"),
        brevity_penalty(F.col("hyp_len"), F.col("close_ref_len")).alias("brevity_penalty"),
    )


def combine_scores(ngram: Column, recall: Column, syntax: Column, flow: Column,
                   alpha: float = 0.25, beta: float = 0.25, gamma: float = 0.25,
                   theta: float = 0.25) -> Column:
    return alpha * ngram + beta * recall + gamma * syntax + theta * flow


def parse_weights(text: str) -> dict[str, float]:
    alpha, beta, gamma, theta = (float(x) for x in text.split(","))
    return {"alpha": alpha, "beta": beta, "gamma": gamma, "theta": theta}
