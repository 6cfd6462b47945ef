"""Running values along an order that no single task has to walk alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
            earlier: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds what the rows before each row come to, in two phases, so a hot key is split.

    `earlier`: name of the new column -> (kind, value): `sum`, `min`, `max` or `last` (the latest value that
    is not null) of the rows of the same keys that come earlier in `order`; null where there are none.
    `bucket` cuts the order into pieces and must not decrease along it; `order` must tell rows
    of a piece apart, else equal rows count as one after another. Pieces are summed up first; only
    those sums are walked for a whole key, and each piece then is walked apart.
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    merge = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
    tagged = df.withColumns({"_bucket": bucket, **{f"_v_{n}": v for n, (_, v) in earlier.items()}})
    at = F.struct(*order)
    totals = tagged.groupBy(*keys, "_bucket").agg(*[
        (F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)) if kind == "last" else kinds[kind](f"_v_{n}")).alias(f"_t_{n}")
        for n, (kind, _) in earlier.items()
    ])
    pieces = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def over(kind: str, column: str, window) -> Column:
        return (F.last(column, ignorenulls=True) if kind == "last" else kinds[kind](column)).over(window)

    carried = totals.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "_bucket")],
                            *[over(kind, f"_t_{n}", pieces).alias(f"_c_{n}") for n, (kind, _) in earlier.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_bucket")]  # null keys are keys too
    joined = tagged.join(carried, reduce(Column.__and__, same))
    out = []
    for n, (kind, _) in earlier.items():
        here, before = over(kind, f"_v_{n}", inside), F.col(f"_c_{n}")
        both = F.coalesce(here, before) if kind == "last" else F.coalesce(merge[kind](here, before), here, before)
        out.append(both.alias(n))
    return joined.select(*df.columns, *out)
