"""Vocabularies: build, truncate, look up, extend per example."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def special_rows(spark: SparkSession, specials: list[str]) -> DataFrame:
    return spark.range(1).select(
        F.posexplode(F.array(*[F.lit(t) for t in specials])).alias("id", "token")
    ).select(F.col("id").cast("bigint").alias("id"), "token", F.lit(True).alias("is_special"))


def build_vocab(tokens: DataFrame, specials: list[str], size: int) -> DataFrame:
    """Special tokens first, then the most frequent tokens; ties by token.

    Counting combines before the shuffle and the top rows are cut per partition, so only
    `size` rows ever meet in one place. The cut also tells the planner how small the result
    is, which is what lets later joins broadcast it.
    """
    room = size - len(specials)
    top = (
        tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "token").limit(room)
    )
    ranked = top.select(
        (F.row_number().over(Window.orderBy(F.desc("cnt"), "token")) + (len(specials) - 1))
        .cast("bigint").alias("id"),
        "token",
        F.lit(False).alias("is_special"),
    )
    return special_rows(tokens.sparkSession, specials).unionByName(ranked)


def truncate_vocab(vocab: DataFrame, size: int) -> DataFrame:
    return vocab.filter(F.col("id") < size)


def special_ids(vocab: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row: for every given column name the id of its token, null when cut off."""
    return vocab.filter(F.col("token").isin(list(names.values()))).agg(
        *[F.min(F.when(F.col("token") == t, F.col("id"))).alias(c) for c, t in names.items()]
    )


def lookup_table(vocab: DataFrame) -> DataFrame:
    """token → id; of duplicate tokens the lowest id wins."""
    return vocab.groupBy("token").agg(F.min("id").alias("id"))


def token_ids(tokens: DataFrame, vocab: DataFrame, unk_id: int = 1) -> DataFrame:
    """Add `id`; unknown tokens get the unknown id."""
    return tokens.join(lookup_table(vocab), "token", "left").withColumn(
        "id", F.coalesce("id", F.lit(unk_id).cast("bigint"))
    )


def line_ids(encoded: DataFrame, keys: list[str], pos: str = "pos", value: str = "id") -> DataFrame:
    """Long token rows back to one array per line; a line bounds the group."""
    rows = F.sort_array(F.collect_list(F.struct(pos, value)))
    return encoded.groupBy(*keys).agg(
        F.transform(rows, lambda r: r.getField(value)).alias(f"{value}s")
    )


def unknown_tokens(tokens: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct out-of-vocabulary tokens per line with the place they first appear."""
    return (
        tokens.join(lookup_table(vocab), "token", "left_anti")
        .groupBy(*keys, "line_no", "token").agg(F.min("pos").alias("first_pos"))
    )


def extended_vocab(source_tokens: DataFrame, vocab: DataFrame, keys: list[str],
                   base_size: int) -> DataFrame:
    """Per example the unknown source tokens, numbered from the base size on."""
    first = unknown_tokens(source_tokens, vocab, keys).groupBy(*keys, "token").agg(
        F.min(F.struct("line_no", "first_pos")).alias("first")
    )
    order = Window.partitionBy(*keys).orderBy("first")
    return first.select(
        *keys, "token",
        (F.row_number().over(order) + (base_size - 1)).cast("bigint").alias("ext_id"),
    )


def extended_ids(tokens: DataFrame, vocab: DataFrame, ext: DataFrame, keys: list[str],
                 unk_id: int = 1) -> DataFrame:
    """Base id, else the example's extended id, else unknown; for source and target alike."""
    return (
        tokens.join(lookup_table(vocab), "token", "left")
        .join(ext, [*keys, "token"], "left")
        .withColumn("id", F.coalesce("id", "ext_id", F.lit(unk_id).cast("bigint")))
        .drop("ext_id")
    )


def plain_id(ext_id: Column, base_size: int, unk_id: int = 1) -> Column:
    """What the decoder may be fed: extended ids become unknown."""
    return F.when(ext_id < base_size, ext_id).otherwise(F.lit(unk_id).cast("bigint"))


def decode_ids(encoded: DataFrame, vocab: DataFrame, ext: DataFrame, keys: list[str]) -> DataFrame:
    """Add `decoded`: the token an id stands for in the example's own vocabulary."""
    base = vocab.groupBy("id").agg(F.min("token").alias("base_token"))
    own = ext.select(*keys, F.col("ext_id").alias("id"), F.col("token").alias("own_token"))
    return (
        encoded.join(base, "id", "left").join(own, [*keys, "id"], "left")
        .withColumn("decoded", F.coalesce("base_token", "own_token"))
        .drop("base_token", "own_token")
    )
