"""Array helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM_SEP = "\u001f"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once, so a lambda in `body` does not evaluate it again per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(size: Column) -> Column:
    """0 … size-1; empty for size 0 (a bare `sequence` would run backwards)."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>")
    )


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def pad_right(arr: Column, size: int, value: Column) -> Column:
    """Cut at `size`, then fill up to it."""
    return let(
        F.slice(arr, 1, size),
        lambda cut: F.concat(cut, F.array_repeat(value, F.greatest(F.lit(size) - F.size(cut), F.lit(0)))),
    )


def joined(arr: Column, sep: str = " ") -> Column:
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), sep)


def ngrams(tokens: Column, n: int, pad_left: bool = False, pad_right: bool = False,
           left_symbol: str = "", right_symbol: str = "") -> Column:
    """All n-grams in order, each an array; optional padding of n-1 symbols per side."""
    parts = []
    if pad_left and n > 1:
        parts.append(F.array_repeat(F.lit(left_symbol), n - 1))
    parts.append(tokens)
    if pad_right and n > 1:
        parts.append(F.array_repeat(F.lit(right_symbol), n - 1))
    seq = F.concat(*parts) if len(parts) > 1 else tokens
    return let(
        seq,
        lambda s: F.transform(
            positions(F.greatest(F.size(s) - (n - 1), F.lit(0))),
            lambda i: F.slice(s, i + 1, n),
        ),
    )


def gram_keys(tokens: str, n: int) -> str:
    """SQL text for n-grams as strings; the separator counts as white space, so no token has it.

    The expressions of this section are text because they are nested often and large: parsing
    one string is much cheaper than building the same tree call by call.
    """
    if n == 1:
        return tokens
    words = ", ".join(f"get(w_, i_ + {k})" for k in range(n))
    return (
        f"get(transform(array({tokens}), w_ -> transform("
        f"if(size(w_) >= {n}, sequence(0, size(w_) - {n}), cast(array() as array<int>)), "
        f"i_ -> concat_ws('\\u001f', {words}))), 0)"
    )


def numbered(keys: str) -> str:
    """SQL text that tags the k-th copy of every key with k.

    On tagged arrays a plain set intersection is the multiset intersection and a plain set
    union is the multiset union with the larger count, so clipped overlaps of two texts need
    neither explode nor shuffle. Linear after the sort.
    """
    starts = "filter(sequence(0, size(g_) - 1), i_ -> i_ = 0 or get(g_, i_) <> get(g_, i_ - 1))"
    copies = (
        "transform(sequence(1, coalesce(get(s_, j_ + 1), size(g_)) - x_), "
        "k_ -> concat(get(g_, x_), '\\u001f\\u001f', k_))"
    )
    return (
        f"get(transform(array(sort_array({keys})), g_ -> "
        f"if(size(g_) = 0, cast(array() as array<string>), get(transform(array({starts}), "
        f"s_ -> flatten(transform(s_, (x_, j_) -> {copies}))), 0))), 0)"
    )


def extra_copies(keys: str) -> str:
    """SQL text for the second and later copies of every key, sorted."""
    return (
        f"get(transform(array(sort_array({keys})), "
        "g_ -> filter(g_, (x_, i_) -> i_ > 0 and x_ = get(g_, i_ - 1))), 0)"
    )


def overlap_size(left: str, right: str) -> str:
    """SQL text for the size of the multiset intersection of two key arrays.

    Distinct keys in common, plus the same for the extra copies, which are few in most texts:
    only those need to be numbered.
    """
    return (
        f"get(transform(array(struct({left} as l, {right} as r)), p_ -> "
        "size(array_intersect(p_.l, p_.r)) + "
        f"size(array_intersect({numbered(extra_copies('p_.l'))}, {numbered(extra_copies('p_.r'))}))), 0)"
    )
