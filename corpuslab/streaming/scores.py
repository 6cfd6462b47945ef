"""Running scores over folders that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.operators.scores import bleu_from_sums, corpus_sums
from corpuslab.operators.segments import seg_stats
from corpuslab.streaming.batches import read_batches, write_batch


def stream_scores(spark: SparkSession, preds_path: str, schema: T.StructType, refs: DataFrame,
                  out_path: str, checkpoint: str, continuous: bool = False):
    """Score prediction files as they arrive.

    Predictions without a reference cannot be scored; each batch counts them per model.

    Score ingredients are sums, so each micro-batch leaves its per-model sums, and older batches are
    merged. A replayed batch takes its own place again and changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        met = batch.join(refs.withColumn("_known", F.lit(True)), "idx", "left").persist()
        try:
            sums = corpus_sums(seg_stats(met.where("_known").drop("_known")), ["model"])
            alone = met.where("_known is null").groupBy("model").agg(F.count(F.lit(1)).alias("unmatched"))
            write_batch(sums.join(alone, "model", "full_outer").na.fill(0), out_path, batch_id, _summed)
        finally:
            met.unpersist()

    stream = spark.readStream.schema(schema).parquet(preds_path)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("model").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "model"])


def rolled_up(spark: SparkSession, out_path: str) -> DataFrame:
    """Scores of everything seen so far, with the number of predictions that had no reference."""
    total = _summed(read_batches(spark, out_path))
    return total.select(
        "model", "n", F.try_divide(F.col("hits") * 100.0, F.col("n")).alias("exact_match"),
        bleu_from_sums(total).alias("bleu"), "unmatched",
    )


def stream_best_epoch(spark: SparkSession, log_path: str, schema: T.StructType, out_path: str,
                      checkpoint: str):
    """Best epoch per run, kept as streaming state; each batch writes the runs that improved."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, out_path, batch_id, _least)

    log = spark.readStream.schema(schema).parquet(log_path)
    best = log.groupBy("run").agg(F.min(F.struct("valid_loss", "epoch")).alias("best"))
    return (
        best.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _least(parts: DataFrame) -> DataFrame:
    return parts.groupBy("run").agg(F.min("best").alias("best"))


def latest_best_epoch(spark: SparkSession, out_path: str) -> DataFrame:
    """The smallest of all updates is the current state."""
    return _least(read_batches(spark, out_path)).select(
        "run", F.col("best.epoch").alias("epoch"), F.col("best.valid_loss").alias("valid_loss")
    )
