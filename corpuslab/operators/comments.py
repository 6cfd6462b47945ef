"""Comment stripping by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import strip_c_comments, strip_python_comments


def strip_comments(df: DataFrame, code: str = "code", lang: str = "lang") -> DataFrame:
    """Strip by the language column: Python by its own rules, Ruby not at all, others C-like."""
    text = F.col(code)
    return df.withColumn(
        code, F.when(F.col(lang) == "python", strip_python_comments(text)).when(F.col(lang) == "ruby", text)
        .otherwise(strip_c_comments(text)),
    )
