"""Reference sets with several texts per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_references(files: list[DataFrame]) -> DataFrame:
    """Aligned (idx, ref) tables, one per reference file, as idx and an array of references.

    The number of files is fixed, so the texts meet by joins on the segment instead of being
    collected; all joins use the same key and share one partitioning.
    """
    out = files[0].select("idx", F.col("ref").alias("_r0"))
    for i, f in enumerate(files[1:], start=1):
        out = out.join(f.select("idx", F.col("ref").alias(f"_r{i}")), "idx")
    return out.select("idx", F.array(*[F.col(f"_r{i}") for i in range(len(files))]).alias("refs"))
