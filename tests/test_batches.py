"""Folders of micro-batches: few, replay-safe, and equal to one batch."""

import os
import random

from pyspark.sql import functions as F

from corpuslab.streaming import scores
from corpuslab.streaming.batches import read_batches, write_batch


def summed(df):
    return df.groupBy("k").agg(F.sum("v").alias("v"))


def test_many_batches_leave_few_folders(spark, tmp_path):
    path, total, rng, most = str(tmp_path / "sums"), {}, random.Random(1), 0
    for b in range(40):
        rows = [(rng.choice("xyz"), rng.randint(1, 9)) for _ in range(3)]
        for again in range(1 + (b % 7 == 3)):  # some batches come twice
            write_batch(spark.createDataFrame(rows, "k string, v bigint").coalesce(1), path, b, summed, apart=4)
        for k, v in rows:
            total[k] = total.get(k, 0) + v
        most = max(most, sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs))
    assert most <= 6 and {r.k: r.v for r in summed(read_batches(spark, path)).collect()} == total
    write_batch(spark.createDataFrame([("x", 100)], "k string, v bigint"), path, 3, summed)  # long merged
    assert {r.k: r.v for r in summed(read_batches(spark, path)).collect()} == total


def test_a_writer_stopped_while_merging_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "sums")
    for b in range(5):
        write_batch(spark.createDataFrame([("x", 1)], "k string, v bigint"), path, b, summed, apart=100)
    # merged but not yet deleted; and a merge that was never finished
    summed(read_batches(spark, path)).coalesce(1).write.parquet(f"{path}/until-4")
    os.makedirs(f"{path}/until-9")
    assert [tuple(r) for r in summed(read_batches(spark, path)).collect()] == [("x", 5)]
    for b in range(5, 12):
        write_batch(spark.createDataFrame([("x", 1)], "k string, v bigint"), path, b, summed, apart=3)
    assert [tuple(r) for r in summed(read_batches(spark, path)).collect()] == [("x", 12)]


def test_stream_over_many_files_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    refs = spark.createDataFrame([(i, f"a b c d {i}") for i in range(40)], "idx bigint, ref string")
    rows = [(rng.choice(["m", "n"]), i, f"a b c {rng.choice('dxy')} {i}") for i in range(46)]
    schema = "model string, idx bigint, hyp string"
    for start in range(0, 46, 4):
        spark.createDataFrame(rows[start:start + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    source = type("S", (), {"readStream": stream, "__getattr__": lambda self, n: getattr(spark, n)})()
    source.readStream.schema = lambda s: stream
    scores.stream_scores(source, str(tmp_path / "in"), schema, refs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.model: (r.n, r.unmatched) for r in scores.rolled_up(spark, str(tmp_path / "out")).collect()}
    want = {m: (sum(x == m and i < 40 for x, i, _ in rows), sum(x == m and i >= 40 for x, i, _ in rows)) for m in ("m", "n")}
    assert got == want
    folders = [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")]
    assert len(folders) <= 10
