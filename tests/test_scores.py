"""BLEU variants and their parts against published values and a plain restatement."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslab.functions.bleu import brevity_penalty
from corpuslab.operators import scores
from corpuslab.operators.references import assemble_references
from corpuslab.operators.segments import seg_stats

R1 = "It is a guide to action that ensures that the military will forever heed Party commands"
R2 = "It is the guiding principle which guarantees the military forces always being under the command of the Party"
R3 = "It is the practical guide for the army always to heed the directions of the party"
H1 = "It is a guide to action which ensures that the military always obeys the commands of the party"
H2 = "It is to insure the troops forever hearing the activity guidebook that party direct"
RB = "he was interested in world history because he read the book"
HB = "he read the book because he was interested in world history"


def stats(spark, rows, order=4, keywords=None):
    df = spark.createDataFrame([("m", i, refs, hyp) for i, (refs, hyp) in enumerate(rows)],
                               "model string, idx bigint, refs array<string>, hyp string")
    return seg_stats(df, refs="refs", max_order=order, keywords=keywords)


def segment(spark, refs, hyp, smoothing="m1", weights=None, **kw):
    s = stats(spark, [(refs, hyp)], order=5)
    return s.select(scores.segment_nbleu(smoothing, weights, **kw).alias("b")).first().b


@pytest.mark.parametrize("refs, hyp, smoothing, weights, want", [
    ([R1, R2, R3], H1, "m1", None, 0.5045),
    ([R1, R2, R3], H2, "m0", None, 0.0),
    ([R1, R2, R3], H2, "m1", None, 0.0370),
    ([R1, R2, R3], H1, "m1", [0.2] * 5, 0.3920),
])
def test_published_segment_scores(spark, refs, hyp, smoothing, weights, want):
    assert segment(spark, refs, hyp, smoothing, weights) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("kind, want", list(zip(
    [f"m{i}" for i in range(8)], [0.4118, 0.4118, 0.4489, 0.4118, 0.4118, 0.4905, 0.4135, 0.4905])))
def test_published_smoothing(spark, kind, want):
    assert segment(spark, [R1], H1, kind) == pytest.approx(want, abs=1e-4)


def test_published_corpus_score(spark):
    rows = [([R1, R2, R3], H1), ([RB], HB)]
    s = stats(spark, rows)
    assert scores.corpus_nbleu(s, ["model"]).first().bleu == pytest.approx(0.5920, abs=1e-4)
    mean = s.select(F.avg(scores.segment_nbleu())).first()[0]
    assert mean == pytest.approx(0.6223, abs=1e-4)


def test_modified_precision(spark):
    s = stats(spark, [(["the cat is on the mat", "there is a cat on the mat"], "the the the the the the the"),
                      ([R1, R2, R3], H1), ([R1, R2, R3], H2)])
    got = {(r.idx, r.n): r.num / r.den for r in scores.modified_precision(s, ["idx"]).collect()}
    assert got[0, 1] == pytest.approx(0.2857, abs=1e-4)
    assert got[1, 1] == pytest.approx(0.9444, abs=1e-4)
    assert got[1, 2] == pytest.approx(0.5882352941176471)
    assert got[2, 1] == pytest.approx(0.5714, abs=1e-4)
    assert got[2, 2] == pytest.approx(0.07692, abs=1e-4)


@pytest.mark.parametrize("refs, hyp, want", [
    ([12, 15, 17], 12, 1.0), ([28, 28], 12, 0.2635971381157267), ([13, 2], 12, 0.9200), ([13, 11], 12, 1.0),
    ([11, 8], 7, 0.8668), ([11, 8, 6, 7], 7, 1.0), ([5], 0, 0.0),
])
def test_brevity_penalty(spark, refs, hyp, want):
    s = stats(spark, [([" ".join("a" * n) for n in refs], " ".join("a" * hyp))])
    got = s.select(brevity_penalty(F.col("hyp_len"), F.col("close_ref_len")).alias("b")).first().b
    assert got == pytest.approx(want, abs=1e-4)


def test_hand_made_values(spark):
    ref, hyp = "int a = b ;", "int a = c ;"
    s = stats(spark, [([ref], hyp)], keywords=["int"])
    assert s.select(scores.segment_bleu().alias("b")).first().b == pytest.approx(0.537284965911771)
    assert segment(spark, [ref], hyp) == pytest.approx(0.28574404296988)
    assert segment(spark, [ref], hyp, "m3") == pytest.approx(0.42728700639623407)
    assert segment(spark, [ref], hyp, "m4") == pytest.approx(0.7987822049880149)
    assert scores.weighted_recall(s, ["model"]).first().weighted_recall == pytest.approx(0.2933705789311311)


def test_single_and_array_reference_agree(spark):
    df = spark.createDataFrame([("m", 0, R1, H1), ("m", 1, RB, HB), ("m", 2, "x", "")],
                               "model string, idx bigint, ref string, hyp string")
    one = seg_stats(df, keywords=["the", "It"]).orderBy("idx").collect()
    many = seg_stats(df.withColumn("refs", F.array("ref")).drop("ref"), refs="refs",
                     keywords=["the", "It"]).orderBy("idx").collect()
    for a, b in zip(one, many):
        assert a.asDict(True) == b.asDict(True)


def test_identical_text_scores_one(spark):
    text = "public int add ( int a )"
    s = stats(spark, [([text], text)], order=5, keywords=["int"])
    row = s.select(scores.segment_bleu().alias("g"), scores.segment_nbleu().alias("n"),
                   scores.segment_weighted_recall(strict_ref_len=True).alias("w")).first()
    assert (row.g, row.n, row.w) == (1.0, 1.0, 1.0)


def test_empty_hypothesis_is_zero(spark):
    s = stats(spark, [(["a b c"], ""), (["a b"], "  ")], order=5, keywords=["a"])
    for kind in ["m0", "m1", "m2", "m3", "m4", "m5", "m7"]:
        assert {r.b for r in s.select(scores.segment_nbleu(kind).alias("b")).collect()} == {0.0}
    assert {r.b for r in s.select(scores.segment_bleu().alias("b")).collect()} == {0.0}


def test_auto_reweigh_uses_hypothesis_length(spark):
    plain = segment(spark, ["a b c"], "a b")
    short = segment(spark, ["a b c"], "a b", auto_reweigh=True)
    bp = math.exp(1 - 3 / 2)
    assert short == pytest.approx(bp * 1.0)
    assert plain == pytest.approx(bp * (1 * 1 * 0.1 * 0.1) ** 0.25)


def test_weighted_smoothing_limited(spark):
    s = stats(spark, [(["a"], "a")], keywords=[])
    with pytest.raises(ValueError):
        scores.weighted_recall(s, ["model"], "m3")


def plain_counts(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def test_random_overlaps_match_counters(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        refs = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 3))]
        rows.append((refs, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))))
    got = stats(spark, rows, order=5).orderBy("idx").collect()
    for (refs, hyp), row in zip(rows, got):
        h, rs = hyp.split(), [r.split() for r in refs]
        for n in range(1, 6):
            best = Counter()
            for r in rs:
                best |= plain_counts(r, n)
            assert row[f"m{n}"] == sum((plain_counts(h, n) & best).values())
        assert row.short_ref_len == min(map(len, rs))
        assert row.close_ref_len == min(map(len, rs), key=lambda x: (abs(x - len(h)), x))


def test_random_recall_matches_counters(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(25):
        refs = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 2))]
        rows.append((refs, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))))
    got = stats(spark, rows, keywords=["a", "d"]).orderBy("idx").collect()
    for (refs, hyp), row in zip(rows, got):
        for n in range(1, 5):
            num = den = 0.0
            for r in refs:
                want = plain_counts(r.split(), n)
                weight = (lambda g: 1.0 if g[0] in "ad" else 0.2) if n == 1 else (lambda g: 1.0)
                have = plain_counts(hyp.split(), n)
                num += sum(weight(g) * min(c, have[g]) for g, c in want.items())
                den += max(1.0, sum(weight(g) * c for g, c in want.items()))
            assert row.recall[n - 1].num == pytest.approx(num)
            assert row.recall[n - 1].den == pytest.approx(den)


def test_scores_do_not_depend_on_partitioning(spark):
    rows = [([R1, R2], H1), ([RB], HB), ([R3], H2)]
    df = spark.createDataFrame([("m", i, r, h) for i, (r, h) in enumerate(rows)],
                               "model string, idx bigint, refs array<string>, hyp string")
    a = scores.corpus_bleu(seg_stats(df.coalesce(1), refs="refs"), ["model"]).first().bleu
    b = scores.corpus_bleu(seg_stats(df.repartition(7), refs="refs"), ["model"]).first().bleu
    assert a == b


def test_assembled_references(spark):
    files = [spark.createDataFrame([(i, f"{k}{i}") for i in range(3)], "idx bigint, ref string") for k in "xyz"]
    got = {r.idx: r.refs for r in assemble_references(files).collect()}
    assert got == {i: [f"x{i}", f"y{i}", f"z{i}"] for i in range(3)}
