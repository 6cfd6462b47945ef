"""Small constant tables as plans whose size the planner knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """Rows of constants; unlike a local collection it has a size estimate, so a join with it
    is planned as a broadcast without a hint."""
    structs = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
