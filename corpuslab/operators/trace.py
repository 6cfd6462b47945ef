"""Decode traces: attention, coverage, copy mixture and loss over long tables.

Normalising sums are aggregated first (combined before the shuffle) and joined back, so an
example with very many positions is not held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.config import LOG_GUARD, MASK_PENALTY, TOP_K_LINES
from corpuslab.operators.scans import running

STEP = ["ex", "step"]


def softmax(df: DataFrame, keys: list[str], score: Column, name: str) -> DataFrame:
    """Softmax of `score` over the rows of each key."""
    scored = df.withColumn("_z", score)
    top = scored.groupBy(*keys).agg(F.max("_z").alias("_top"))
    shifted = scored.join(top, keys).withColumn("_e", F.exp(F.col("_z") - F.col("_top")))
    total = shifted.groupBy(*keys).agg(F.sum("_e").alias("_total"))
    return (
        shifted.join(total, keys).withColumn(name, F.col("_e") / F.col("_total"))
        .drop("_z", "_top", "_e", "_total")
    )


def masked_softmax(attn: DataFrame, keys: list[str] | None = None, score: str = "score",
                   mask: str = "mask", name: str = "weight") -> DataFrame:
    return softmax(attn, keys or STEP, F.col(score) + F.col(mask) * F.lit(MASK_PENALTY), name)


def context_vectors(weighted: DataFrame, keys: list[str], vector: str,
                    weight: str = "weight") -> DataFrame:
    """Weighted sum of vectors, one row per key and dimension."""
    long = weighted.select(*keys, weight, F.posexplode(vector).alias("dim", "_v"))
    return long.groupBy(*keys, "dim").agg(
        F.sum(F.col(weight) * F.col("_v").cast("double")).alias("value")
    )


def coverage(weights: DataFrame, source: list[str] | None = None, pieces: int | None = None) -> DataFrame:
    """Weight each source position has received in earlier steps.

    With `pieces`, so many steps are walked together, and the steps of one position are spread over tasks."""
    if pieces is not None:
        summed = running(weights, ["ex", *(source or ["src"])], F.floor(F.col("step") / pieces), [F.col("step")],
                         {"coverage": ("sum", F.col("weight"))})
        return summed.withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    earlier = (
        Window.partitionBy("ex", *(source or ["src"])).orderBy("step")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return weights.withColumn(
        "coverage", F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    )


def coverage_penalty(covered: DataFrame) -> DataFrame:
    return covered.groupBy(*STEP).agg(
        F.sum(F.least("coverage", "weight")).alias("penalty"),
        F.max("y_mask").alias("y_mask"),
    )


def line_weights(weights: DataFrame) -> DataFrame:
    """Attention per source line."""
    return weights.groupBy(*STEP, "line_no").agg(
        F.sum("weight").alias("weight"), F.max("y_mask").alias("y_mask")
    )


def top_sources(weights: DataFrame, k: int = TOP_K_LINES, source: str = "src",
                digits: int | None = None) -> DataFrame:
    """The k heaviest sources per step; a rank limit is applied before the shuffle too.

    `digits` rounds before comparing, so that noise of the sums does not break ties.
    """
    weight = F.round("weight", digits) if digits is not None else F.col("weight")
    rank = F.row_number().over(
        Window.partitionBy(*STEP).orderBy(weight.desc(), F.col(source))
    )
    return weights.withColumn("rank", rank).filter(F.col("rank") <= k)


def gather_and_write_back(covered: DataFrame, selected: DataFrame, source: str = "src") -> DataFrame:
    """Coverage after a step that saw the selected sources only; the others keep theirs."""
    keys = [*STEP, source]
    updated = covered.join(selected.select(*keys), keys, "left_semi").select(
        *keys, (F.col("coverage") + F.col("weight")).alias("_new")
    )
    return covered.join(updated, keys, "left").withColumn(
        "coverage_after", F.coalesce("_new", "coverage")
    ).drop("_new")


def copy_mixture(dist: DataFrame, weights: DataFrame) -> DataFrame:
    """p_gen times the vocabulary part plus (1 − p_gen) times the copied attention."""
    gate = weights.groupBy(*STEP).agg(F.max("p_gen").alias("p_gen"))
    generated = dist.join(gate, STEP).select(*STEP, "id", (F.col("p") * F.col("p_gen")).alias("p"))
    copied = weights.select(
        *STEP, F.col("ext_id").alias("id"),
        (F.col("weight") * (1 - F.col("mask")) * (1 - F.col("p_gen"))).alias("p"),
    )
    return generated.unionByName(copied).groupBy(*STEP, "id").agg(F.sum("p").alias("p"))


def greedy(mixture: DataFrame, digits: int | None = None) -> DataFrame:
    """Most probable id per step, the lowest on ties; `digits` rounds before comparing."""
    rank_p = F.round("p", digits) if digits is not None else F.col("p")
    best = F.max(F.struct(rank_p.alias("rank_p"), (-F.col("id")).alias("neg"), "p"))
    return mixture.groupBy(*STEP).agg(best.alias("b")).select(
        *STEP, (-F.col("b.neg")).alias("id"), F.col("b.p").alias("p")
    )


def masked_nll(mixture: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Mean of −ln p(target) over unmasked steps; an optional `loss_weight` column scales."""
    truth = targets.join(
        mixture.withColumnRenamed("id", "y_true"), [*STEP, "y_true"], "left"
    ).withColumn("p", F.coalesce("p", F.lit(0.0)))
    scale = F.col("loss_weight") if "loss_weight" in targets.columns else F.lit(1.0)
    keep = 1 - F.col("y_mask")
    return truth.groupBy(*by).agg(
        F.try_divide(
            F.sum(-F.ln(F.col("p") + LOG_GUARD) * scale * keep), F.sum(keep)
        ).alias("nll")
    )


def mean_penalty(penalties: DataFrame, by: list[str], name: str = "penalty") -> DataFrame:
    keep = 1 - F.col("y_mask")
    return penalties.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("penalty") * keep), F.sum(keep)).alias(name)
    )


def total_loss(nll: DataFrame, line_penalty: DataFrame, word_penalty: DataFrame, by: list[str],
               line_factor: float = 1.0, word_factor: float = 1.0) -> DataFrame:
    return nll.join(line_penalty, by).join(word_penalty, by).withColumn(
        "loss",
        F.col("nll") + line_factor * F.col("line_penalty") + word_factor * F.col("word_penalty"),
    )


def forced_copy_weights(covered: DataFrame, lines: DataFrame) -> DataFrame:
    """Weight of copying a position: little covered, unmasked, in a heavy line."""
    soft = softmax(covered, STEP, F.col("coverage") - F.col("mask") * F.lit(1e9), "_soft")
    count = covered.groupBy(*STEP).agg(F.count(F.lit(1)).alias("_n"))
    line = lines.select(*STEP, "line_no", F.col("weight").alias("_line"))
    return (
        soft.join(count, STEP).join(line, [*STEP, "line_no"])
        .withColumn(
            "copy_weight",
            F.try_divide(1 - F.col("mask") - F.col("_soft"), F.col("_n") - 1) * F.col("_line"),
        )
        .drop("_soft", "_n", "_line")
    )


def sample_forced_copy(weights: DataFrame, seed: int = 0, keep: float = 0.4) -> DataFrame:
    """Draw one position per step in proportion to its weight (Gumbel keys from a seeded hash);
    the loss weight of the draw is kept with the given probability, else 0."""
    def uniform(*cols: Column) -> Column:
        digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))
        return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / float(2**52)

    draw = uniform(F.col("ex"), F.col("step"), F.col("src"), F.lit(seed))
    key = F.ln("copy_weight") - F.ln(-F.ln(draw))
    best = weights.filter(F.col("copy_weight") > 0).groupBy(*STEP).agg(
        F.max_by(F.struct("src", "ext_id", "copy_weight"), key).alias("b")
    )
    kept = uniform(F.col("ex"), F.col("step"), F.lit(seed + 1)) >= 1 - keep
    return best.select(
        *STEP, "b.src", "b.ext_id", F.when(kept, F.col("b.copy_weight")).otherwise(0.0).alias("loss_weight")
    )
