"""Row numbers that no single task has to produce alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_within(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
                name: str = "rank") -> DataFrame:
    """1, 2, … per key in the given order, in two phases so that a hot key is split.

    `bucket` cuts the order into pieces: it must not decrease along `order` within a key. Rows
    are numbered inside their piece; the much smaller table of piece sizes gives the offsets.
    """
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = sizes.select(
        *keys, "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_inside").cast("bigint") + F.col("_offset"))
        .drop("_bucket", "_inside", "_offset")
    )


def digest_rank(df: DataFrame, order: Column, ties: list[Column], keys: list[str], digits: int = 3,
                name: str = "rank") -> DataFrame:
    """Rank by a hexadecimal digest: its first digits are even pieces, known without sampling."""
    keyed = df.withColumn("_all", F.lit(0)).withColumn("_order", order)
    piece = F.substring("_order", 1, digits)
    ranked = rank_within(keyed, ["_all", *keys], piece, [F.col("_order"), *ties], name)
    return ranked.drop("_all", "_order")
