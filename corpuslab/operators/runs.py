"""Training runs: names, loss logs, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.config import KEEP_CHECKPOINTS
from corpuslab.operators.scans import running


def _flag(cond: Column, text: str) -> Column:
    return F.when(cond, F.lit(text))


def hierarchical_name() -> Column:
    """Run name from columns pointer, sentence_coverage, word_coverage, force_copy, reverse,
    feed ('gate', 'res' or null), sentence_layer, word_layer, top_k, hidden."""
    sizes = [F.col(c).cast("string") for c in ("sentence_layer", "word_layer", "top_k", "hidden")]
    return F.concat_ws(
        "_", F.lit("hie"), _flag(F.col("pointer"), "pointer"),
        _flag(F.col("sentence_coverage"), "Scov"), _flag(F.col("word_coverage"), "Wcov"),
        _flag(F.col("word_coverage") & F.col("force_copy"), "Fcopy"),
        _flag(F.col("reverse"), "rev"),
        F.when(F.col("feed").isNotNull(), F.concat(F.lit("feed"), F.col("feed"))), *sizes,
    )


def flat_name() -> Column:
    """Run name from columns pointer, coverage, reverse, layer, hidden, vocab_size."""
    sizes = [F.col(c).cast("string") for c in ("layer", "hidden", "vocab_size")]
    return F.concat_ws(
        "_", F.lit("pgn"), _flag(F.col("pointer"), "pointer"), _flag(F.col("coverage"), "cov"),
        _flag(F.col("reverse"), "rev"), *sizes,
    )


def parse_run_name(df: DataFrame, name: str = "run_name") -> DataFrame:
    """Run name back to columns; what a family does not have is null."""
    col = F.col(name)
    family = F.regexp_extract(col, "^([a-z]+)_", 1)
    hier = family == "hie"

    def has(part: str) -> Column:
        return col.rlike(f"_{part}(_|$)")

    def number(group: int, only: Column) -> Column:
        pattern = r"_(\d+)_(\d+)_(\d+)_(\d+)$"
        return F.when(only, F.regexp_extract(col, pattern, group).try_cast("bigint"))

    def flat_number(group: int) -> Column:
        pattern = r"_(\d+)_(\d+)_(\d+)$"
        return F.when(~hier, F.regexp_extract(col, pattern, group).try_cast("bigint"))

    feed = F.regexp_extract(col, r"_feed(gate|res)_", 1)
    return df.withColumns({
        "family": family,
        "pointer": has("pointer"),
        "coverage": has("cov") | has("Scov") | has("Wcov"),
        "force_copy": has("Fcopy"),
        "reverse": has("rev"),
        "feed": F.when(feed != "", feed),
        "layers": F.when(hier, number(1, hier)).otherwise(flat_number(1)),
        "word_layer": number(2, hier),
        "top_k": number(3, hier),
        "hidden": F.when(hier, number(4, hier)).otherwise(flat_number(2)),
        "vocab_size": flat_number(3),
    })


def parse_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """`train valid` per line to two numbers; broken lines give nulls."""
    part = F.split(F.trim(F.col(line)), " +")
    return lines.withColumns({
        "train_loss": F.try_element_at(part, F.lit(1)).try_cast("double"),
        "valid_loss": F.try_element_at(part, F.lit(2)).try_cast("double"),
    }).drop(line)


def cut_epochs(log: DataFrame, epochs: int | Column) -> DataFrame:
    return log.filter(F.col("epoch") <= epochs)


def best_epoch(log: DataFrame) -> DataFrame:
    """First epoch with the smallest validation loss."""
    best = F.min(F.struct("valid_loss", "epoch"))
    return log.groupBy("run").agg(best.alias("b")).select(
        "run", F.col("b.epoch").alias("epoch"), F.col("b.valid_loss").alias("valid_loss")
    )


def checkpoint_plan(log: DataFrame, keep: int = KEEP_CHECKPOINTS, pieces: int | None = None) -> DataFrame:
    """Epochs that are saved: no worse than every earlier one, or last; the newest are kept.

    With `pieces`, so many epochs are walked together, and one long run is spread over tasks."""
    if pieces is not None:
        piece, late = F.floor(F.col("epoch") / pieces), [F.desc("epoch")]
        low = running(log, ["run"], piece, [F.col("epoch")], {"_low": ("min", F.col("valid_loss"))})
        last = running(low, ["run"], -piece, late, {"_after": ("sum", F.lit(1))}, )
        saved = last.filter(F.col("_low").isNull() | (F.col("valid_loss") <= F.col("_low")) | F.col("_after").isNull())
        newer = running(saved.drop("_low", "_after"), ["run"], -piece, late, {"_newer": ("sum", F.lit(1))})
        return newer.withColumn("kept", F.coalesce("_newer", F.lit(0)) < keep).drop("_newer")
    by_epoch = Window.partitionBy("run").orderBy("epoch")
    earlier = F.min("valid_loss").over(by_epoch.rowsBetween(Window.unboundedPreceding, -1))
    final = F.lead("epoch").over(by_epoch).isNull()
    saved = (
        log.withColumn("_low", earlier).withColumn("_final", final)
        .filter(F.col("_low").isNull() | (F.col("valid_loss") <= F.col("_low")) | F.col("_final"))
        .drop("_low", "_final")
    )
    newest = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("epoch")))
    return saved.withColumn("kept", newest <= keep)


def epoch_means(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run", "epoch").agg(
        F.count(F.lit(1)).alias("steps"), F.avg("loss").alias("mean_loss")
    )


def resume_state(log: DataFrame, restored: DataFrame) -> DataFrame:
    """Log up to the restored epoch per run, summed up: epochs kept and the minimum so far."""
    return (
        log.join(restored.withColumnRenamed("epoch", "restored_epoch"), "run")
        .filter(F.col("epoch") <= F.col("restored_epoch"))
        .groupBy("run").agg(
            F.max("restored_epoch").alias("restored_epoch"),
            F.count(F.lit(1)).alias("epochs_kept"),
            F.min("valid_loss").alias("min_valid_loss"),
        )
    )
