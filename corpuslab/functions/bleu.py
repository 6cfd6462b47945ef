"""Score formulas over arrays of per-order counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.config import SMOOTH_ALPHA, SMOOTH_EPSILON, SMOOTH_K, TINY
from corpuslab.functions.arrays import let, positions

Smoother = Callable[["Counts"], Column]


class Counts:
    """Matched and possible n-grams per order, plus what some smoothers need besides."""

    def __init__(self, num: Column, den: Column, hyp_len: Column,
                 next_order: Column | None = None):
        self.num = num.cast("array<double>")
        self.den = den.cast("array<double>")
        self.hyp_len = hyp_len.cast("double")
        self.next_order = next_order

    def per_order(self, body: Callable[[Column, Column, Column], Column]) -> Column:
        """array of body(index, num, den)"""
        return F.transform(
            F.arrays_zip(self.num.alias("n"), self.den.alias("d")),
            lambda x, i: body(i, x.getField("n"), x.getField("d")),
        )

    def precisions(self) -> Column:
        return self.per_order(lambda i, n, d: n / d)


def _or_plain(n: Column, d: Column, instead: Column) -> Column:
    return F.when(n == 0, instead).otherwise(n / d)


def smooth_0(c: Counts) -> Column:
    return c.per_order(lambda i, n, d: _or_plain(n, d, F.lit(TINY)))


def smooth_1(c: Counts) -> Column:
    return c.per_order(lambda i, n, d: _or_plain(n, d, F.lit(SMOOTH_EPSILON) / d))


def smooth_2(c: Counts) -> Column:
    return c.per_order(lambda i, n, d: (n + 1) / (d + 1))


def smooth_3(c: Counts) -> Column:
    """The k-th empty order counts 1/2^k."""
    def empty_so_far(i: Column) -> Column:
        return F.size(F.filter(F.slice(c.num, 1, i + 1), lambda n: n == 0))

    return c.per_order(
        lambda i, n, d: _or_plain(n, d, 1.0 / (F.pow(F.lit(2.0), empty_so_far(i)) * d))
    )


def smooth_4(c: Counts) -> Column:
    """Empty orders count (index + k/ln length), index from zero and k/ln as one term."""
    return c.per_order(
        lambda i, n, d: _or_plain(
            n, d, (i + F.try_divide(F.lit(float(SMOOTH_K)), F.ln(c.hyp_len))) / d
        )
    )


def _neighbour_mean(p: Column, beyond: Column) -> Column:
    """Mean of the already averaged order below, this order and the raw order above."""
    def step(acc: Column, i: Column, ps: Column) -> Column:
        below = F.element_at(acc, -1)
        above = F.coalesce(F.get(ps, i + 1), beyond)
        return F.concat(acc, F.array((below + F.get(ps, i) + above) / 3.0))

    return let(
        p,
        lambda ps: F.slice(
            F.aggregate(
                positions(F.size(ps)),
                F.array(F.get(ps, F.lit(0)) + 1.0),
                lambda acc, i: step(acc, i, ps),
            ),
            2,
            F.size(ps),
        ),
    )


def smooth_5(c: Counts) -> Column:
    return _neighbour_mean(c.precisions(), c.next_order)


def smooth_6(c: Counts) -> Column:
    """From the third order on, mix in a prior from the two orders below; needs a third order."""
    def step(acc: Column, i: Column) -> Column:
        p1, p2 = F.element_at(acc, -1), F.element_at(acc, -2)
        prior = F.when(p2 == 0, 0.0).otherwise(p1 * p1 / p2)
        grams = F.greatest(c.hyp_len - i, F.lit(0.0))
        mixed = (F.get(c.num, i) + SMOOTH_ALPHA * prior) / (grams + SMOOTH_ALPHA)
        return F.concat(acc, F.array(mixed))

    mixed = F.aggregate(
        F.slice(positions(F.size(c.num)), 3, F.size(c.num)),
        F.slice(c.precisions(), 1, 2),
        step,
    )
    return F.when(F.get(c.num, F.lit(2)) != 0, mixed)


def smooth_7(c: Counts) -> Column:
    return _neighbour_mean(smooth_4(c), c.next_order)


SMOOTHERS: dict[str, Smoother] = {
    "m0": smooth_0, "m1": smooth_1, "m2": smooth_2, "m3": smooth_3,
    "m4": smooth_4, "m5": smooth_5, "m6": smooth_6, "m7": smooth_7,
}


def smoother(kind: str | Smoother) -> Smoother:
    return SMOOTHERS[kind] if isinstance(kind, str) else kind


def brevity_penalty(hyp_len: Column, ref_len: Column) -> Column:
    return (
        F.when(hyp_len > ref_len, 1.0)
        .when(hyp_len == 0, 0.0)
        .otherwise(F.exp(1.0 - F.try_divide(ref_len.cast("double"), hyp_len)))
    )


def weighted_log_mean(p: Column, weights: list[float] | Column) -> Column:
    """exp of the weighted sum of logs; surplus orders or weights are ignored."""
    if isinstance(weights, list):
        weights = F.array(*[F.lit(float(w)) for w in weights])
    logs = F.transform(p, F.ln)
    both = F.filter(
        F.zip_with(weights, logs, lambda w, x: F.struct(w.alias("w"), x.alias("x"))),
        lambda s: s.getField("w").isNotNull(),
    )
    return F.exp(
        F.aggregate(both, F.lit(0.0), lambda acc, s: acc + s.getField("w") * s.getField("x"))
    )


def plain_bleu(num: Column, possible: Column, hyp_len: Column, ref_len: Column,
               smooth: bool = True) -> Column:
    """Variant with add-one on all orders and the shortest reference; 0 if an order is empty."""
    n, d = num.cast("array<double>"), possible.cast("array<double>")
    pairs = F.zip_with(
        n, d,
        (lambda a, b: (a + 1.0) / (b + 1.0)) if smooth
        else (lambda a, b: F.when(b > 0, a / b).otherwise(0.0)),
    )

    def score(p: Column) -> Column:
        mean = F.when(
            F.array_min(p) > 0,
            F.exp(F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.ln(x)) / F.size(p)),
        ).otherwise(0.0)
        return mean * brevity_penalty(hyp_len, ref_len)

    return let(pairs, score)


def smoothed_bleu(counts: Counts, ref_len: Column, smoothing: str | Smoother = "m1",
                  weights: list[float] | None = None, auto_reweigh: bool = False) -> Column:
    """Variant with selectable smoothing and the closest reference; 0 without a shared word."""
    fixed = weights or [0.25] * 4
    chosen: list[float] | Column = fixed
    if auto_reweigh and fixed == [0.25] * 4:
        short = F.array_repeat(F.try_divide(F.lit(1.0), counts.hyp_len), counts.hyp_len.cast("int"))
        chosen = F.when(counts.hyp_len < 4, short).otherwise(
            F.array(*[F.lit(w) for w in fixed])
        )
    precision = smoother(smoothing)(counts)
    return F.when(F.get(counts.num, F.lit(0)) == 0, 0.0).otherwise(
        brevity_penalty(counts.hyp_len, ref_len) * weighted_log_mean(precision, chosen)
    )
