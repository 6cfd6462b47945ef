"""Size statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.config import LINE_TOKEN_EDGES, SNIPPET_LINE_EDGES, SNIPPET_TOKEN_EDGES
from corpuslab.functions.text import drop_empty


def _histogram(value: Column, edges: tuple[int, ...]) -> list[Column]:
    lows, highs = (None, *edges), (*edges, None)
    out = []
    for i, (low, high) in enumerate(zip(lows, highs)):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value < high)
        out.append(F.count_if(inside).alias(f"bin{i}"))
    return out


def _summary(df: DataFrame, by: list[str], value: str, edges: tuple[int, ...]) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.sum(v).alias("sum"), *_histogram(v, edges),
    )


def line_sizes(matrices: DataFrame, sides: dict[str, str]) -> DataFrame:
    """side, sizes: token counts of the non-empty lines, still one row per snippet."""
    per_side = F.array(*[
        F.struct(
            F.lit(name).alias("side"),
            F.transform(drop_empty(F.col(col)), lambda x: F.size(x).cast("bigint")).alias("sizes"),
        )
        for name, col in sides.items()
    ])
    return matrices.select(F.inline(per_side))


def tokens_per_snippet(sizes: DataFrame) -> DataFrame:
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _summary(sizes.select("side", total.alias("v")), ["side"], "v", SNIPPET_TOKEN_EDGES)


def lines_per_snippet(sizes: DataFrame) -> DataFrame:
    lines = F.size("sizes").cast("bigint")
    return _summary(sizes.select("side", lines.alias("v")), ["side"], "v", SNIPPET_LINE_EDGES)


def tokens_per_line(sizes: DataFrame) -> DataFrame:
    return _summary(
        sizes.select("side", F.explode("sizes").alias("v")), ["side"], "v", LINE_TOKEN_EDGES
    )


def corpus_report(sizes: DataFrame) -> DataFrame:
    """All three summaries in long form: side, measure, statistic, value."""
    named = {
        "tokens_per_snippet": tokens_per_snippet(sizes),
        "lines_per_snippet": lines_per_snippet(sizes),
        "tokens_per_line": tokens_per_line(sizes),
    }
    parts = []
    for measure, df in named.items():
        stats = [c for c in df.columns if c != "side"]
        wide = df.select("side", *[F.col(c).cast("double").alias(c) for c in stats])
        parts.append(
            wide.unpivot("side", stats, "statistic", "value").withColumn("measure", F.lit(measure))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("side", "measure", "statistic", "value")
