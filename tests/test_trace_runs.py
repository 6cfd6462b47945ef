"""Decode traces, run logs, reports."""

import math

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import reports, runs, trace

ATTN = ("ex bigint, step bigint, src bigint, line_no bigint, score double, mask int, ext_id bigint, p_gen double, "
        "y_true bigint, y_mask int")


def attn(spark, rows):
    return spark.createDataFrame(rows, ATTN)


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(e, s, p, p // 3, float((e * 7 + s * 3 + p * 5) % 11), int(p % 5 == 4), p % 4, 0.3, s % 4, int(s == 2))
            for e in range(3) for s in range(4) for p in range(12)]
    return attn(spark, rows)


def test_softmax_sums_to_one_and_masks(spark, sample):
    w = trace.masked_softmax(sample)
    for r in w.groupBy("ex", "step").agg(F.sum("weight").alias("t")).collect():
        assert r.t == pytest.approx(1.0)
    assert w.filter("mask = 1").agg(F.max("weight")).first()[0] == 0.0


def test_fully_masked_step_stays_finite(spark):
    w = trace.masked_softmax(attn(spark, [(0, 0, p, 0, 1.0, 1, 0, 0.5, 0, 0) for p in range(4)])).collect()
    assert [r.weight for r in w] == [0.25] * 4


def test_next_coverage_is_coverage_plus_weight(spark, sample):
    rows = {(r.ex, r.step, r.src): r for r in trace.coverage(trace.masked_softmax(sample)).collect()}
    for (e, s, p), r in rows.items():
        if s < 3:
            assert rows[e, s + 1, p].coverage == pytest.approx(r.coverage + r.weight)
        if s == 0:
            assert r.coverage == 0.0


def test_copy_mixture(spark):
    weights = spark.createDataFrame([(0, 0, 0, 1, 0.5, 0, 0.5), (0, 0, 1, 3, 0.25, 0, 0.5), (0, 0, 2, 3, 0.25, 0, 0.5)],
                                    "ex bigint, step bigint, src bigint, ext_id bigint, weight double, mask int, p_gen double")
    dist = spark.createDataFrame([(0, 0, i, p) for i, p in enumerate([0.2, 0.3, 0.5])], "ex bigint, step bigint, id bigint, p double")
    mix = trace.copy_mixture(dist, weights)
    assert {r.id: pytest.approx(r.p) for r in mix.collect()} == {0: 0.1, 1: 0.4, 2: 0.25, 3: 0.25}
    assert trace.greedy(mix).first().id == 1
    tie = spark.createDataFrame([(0, 0, 5, 0.5), (0, 0, 2, 0.5)], "ex bigint, step bigint, id bigint, p double")
    assert trace.greedy(tie).first().id == 2


def test_loss(spark):
    mix = spark.createDataFrame([(0, 0, 1, 0.5), (0, 1, 1, 0.25)], "ex bigint, step bigint, id bigint, p double")
    y = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 9, 0), (0, 2, 1, 1)], "ex bigint, step bigint, y_true bigint, y_mask int")
    want = (-math.log(0.5 + 1e-10) - math.log(1e-10)) / 2
    assert trace.masked_nll(mix, y, ["ex"]).first().nll == pytest.approx(want)
    scaled = y.withColumn("loss_weight", F.lit(0.5))
    assert trace.masked_nll(mix, scaled, ["ex"]).first().nll == pytest.approx(want / 2)


def test_topk_and_write_back(spark, sample):
    cov = trace.coverage(trace.masked_softmax(sample))
    top = trace.top_sources(cov, 5)
    assert {r["count"] for r in top.groupBy("ex", "step").count().collect()} == {5}
    out = trace.gather_and_write_back(cov, top)
    chosen = {(r.ex, r.step, r.src) for r in top.collect()}
    for r in out.collect():
        want = r.coverage + (r.weight if (r.ex, r.step, r.src) in chosen else 0.0)
        assert r.coverage_after == pytest.approx(want)
    assert out.count() == cov.count()


def test_rank_limit_reaches_below_the_shuffle(sample):
    plan = trace.top_sources(trace.masked_softmax(sample), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_forced_copy(spark, sample):
    w = trace.masked_softmax(sample)
    cov = trace.coverage(w)
    weights = trace.forced_copy_weights(cov, trace.line_weights(w))
    assert weights.filter("mask = 1").agg(F.max(F.abs("copy_weight"))).first()[0] == pytest.approx(0.0)
    draws = trace.sample_forced_copy(weights, seed=3)
    again = trace.sample_forced_copy(weights.repartition(5), seed=3)
    key = lambda df: sorted((r.ex, r.step, r.src, round(r.loss_weight, 9)) for r in df.collect())
    assert key(draws) == key(again) and len(key(draws)) == 12
    allowed = {(r.ex, r.step, r.src) for r in weights.filter("copy_weight > 0").collect()}
    assert {(e, s, p) for e, s, p, _ in key(draws)} <= allowed


def test_sampling_follows_the_weights(spark):
    rows = [(e, 0, p, p, w) for e in range(4000) for p, w in enumerate([0.1, 0.6, 0.3])]
    df = spark.createDataFrame(rows, "ex bigint, step bigint, src bigint, ext_id bigint, copy_weight double")
    out = trace.sample_forced_copy(df, seed=1)
    share = {r.src: r["count"] / 4000 for r in out.groupBy("src").count().collect()}
    assert share[1] == pytest.approx(0.6, abs=0.05) and share[0] == pytest.approx(0.1, abs=0.03)
    kept = out.filter("loss_weight > 0").count() / 4000
    assert kept == pytest.approx(0.4, abs=0.05)


def log(spark, losses, run="a"):
    return spark.createDataFrame([(run, i + 1, 0.0, float(v)) for i, v in enumerate(losses)],
                                 "run string, epoch bigint, train_loss double, valid_loss double")


def test_checkpoints_and_best_epoch(spark):
    df = log(spark, [3, 2, 2, 4, 1, 5])
    plan = runs.checkpoint_plan(df).orderBy("epoch").collect()
    assert [r.epoch for r in plan] == [1, 2, 3, 5, 6] and [r.epoch for r in plan if r.kept] == [3, 5, 6]
    assert runs.best_epoch(df).first().epoch == 5
    assert runs.best_epoch(log(spark, [2, 1, 1])).first().epoch == 2


def test_resume(spark):
    restored = spark.createDataFrame([("a", 3)], "run string, epoch bigint")
    row = runs.resume_state(log(spark, [3, 2, 2, 1]), restored).first()
    assert (row.epochs_kept, row.min_valid_loss) == (3, 2.0)


@pytest.mark.parametrize("name, want", [
    ("hie_pointer_Scov_Wcov_rev_feedgate_1_1_10_64", dict(family="hie", pointer=True, coverage=True, reverse=True, feed="gate", layers=1, top_k=10, hidden=64)),
    ("hie_1_2_10_32", dict(pointer=False, coverage=False, reverse=False, feed=None, word_layer=2, hidden=32)),
    ("pgn_pointer_cov_rev_1_64_4176", dict(family="pgn", pointer=True, coverage=True, reverse=True, layers=1, hidden=64, vocab_size=4176, top_k=None)),
])
def test_run_names(spark, name, want):
    row = runs.parse_run_name(spark.createDataFrame([(name,)], "run_name string")).first()
    assert {k: row[k] for k in want} == want


def test_run_name_round_trip(spark):
    df = spark.createDataFrame([(True, True, False, True, False, "res", 1, 1, 10, 64)],
                               "pointer boolean, sentence_coverage boolean, word_coverage boolean, force_copy boolean, reverse boolean, "
                               "feed string, sentence_layer int, word_layer int, top_k int, hidden int")
    assert df.select(runs.hierarchical_name()).first()[0] == "hie_pointer_Scov_feedres_1_1_10_64"


def test_broken_log_line_is_null(spark):
    df = spark.createDataFrame([("1.5 2.5",), ("x",), ("",)], "line string")
    got = [(r.train_loss, r.valid_loss) for r in runs.parse_log_lines(df).collect()]
    assert got == [(1.5, 2.5), (None, None), (None, None)]


def test_length_curves(spark):
    df = spark.createDataFrame([("a", 5, 1.0), ("a", 45, 3.0), ("b", 999, 2.0)], "model string, len bigint, s double")
    full = reports.scores_by_length(df, F.col("len"), ["s"])
    got = {(r.model, r.bucket): r.s for r in full.collect()}
    assert got["a", 0] == 1.0 and got["a", 1] == 0.0 and got["a", 2] == 3.0 and got["b", 10] == 2.0 and len(got) == 22
    short = reports.scores_by_length(df.filter("model = 'a'"), F.col("len"), ["s"])
    assert sorted(r.bucket for r in short.collect()) == [0, 1, 2]
    labels = {r.bucket: r.label for r in reports.bucket_labels(short).collect()}
    assert labels == {0: "20", 1: "40", 2: ">40"}


def test_side_by_side(spark):
    df = spark.createDataFrame([("a", 1, "r1", "x"), ("b", 1, "r1", "y"), ("a", 2, "r2", "z")], "model string, idx bigint, ref string, hyp string")
    b = {r.idx: (r.ref, r.a, r.b) for r in reports.side_by_side_rows(df, ["a", "b"]).collect()}
    assert b == {1: ("r1", "x", "y"), 2: ("r2", "z", None)}
