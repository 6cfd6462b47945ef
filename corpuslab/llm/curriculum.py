"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. A source's weight over time is a broken line through knots
(time, weight). Its integral up to a time, as a share of the whole integral, is the share of the
source's words that must have been met by then; so a document whose words begin at some place of
the source's stream (documents in the order of a digest, pass after pass) is met at the time where
that cumulative demand reaches the place. Documents of all sources are range-sorted by these times.

How many words a source gives is its whole integral's share of the budget, at most `repeats` times
its size; what a source cannot give goes to the others by weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.functions.arrays import let
from corpuslab.llm.common import written
from corpuslab.operators.ranks import rank_within

Knots = list[tuple[float, float]]

WORD = r"[^\x20\x09-\x0D]+"
#: Entries of a source's stream that are ordered together, about.
LOT = 50_000


def segments(knots: Knots) -> list[tuple[float, float, float, float, float]]:
    """(start, width, weight there, slope, integral before) of each part of a broken line from time
    0 to 1."""
    times = [t for t, _ in knots]
    if len(knots) < 2 or times[0] != 0 or times[-1] != 1 or sorted(set(times)) != times or min(w for _, w in knots) < 0:
        raise ValueError("knots need rising times from 0 to 1 and weights that are not negative")
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((float(t0), float(t1 - t0), float(w0), (w1 - w0) / (t1 - t0), before))
        before += (t1 - t0) * (w0 + w1) / 2
    return out


def integral(knots: Knots) -> float:
    start, width, weight, slope, before = segments(knots)[-1]
    return before + width * (weight + weight + slope * width) / 2


def _schedule(knots: Knots) -> Column:
    parts = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("t", "width", "w", "slope", "before"), s)])
        for s in segments(knots)
    ]
    return F.struct(F.lit(integral(knots)).alias("weight"), F.array(*parts).alias("parts"))


def time_of(place: Column, words: Column, schedule: Column) -> Column:
    """The time at which a source's cumulative demand of `words` reaches `place`."""
    demand = place.cast("double") / words * schedule["weight"]

    def solved(y: Column) -> Column:
        part = F.element_at(F.filter(schedule["parts"], lambda s: s["before"] <= y), -1)

        def inside(s: Column) -> Column:
            rest = y - s["before"]
            root = F.sqrt(F.greatest(F.lit(0.0), s["w"] * s["w"] + 2 * s["slope"] * rest))
            step = F.when(rest > 0, 2 * rest / (s["w"] + root)).otherwise(0.0)
            return s["t"] + F.least(step, s["width"])

        return let(part, inside)

    return let(demand, solved)


def targets(sizes: DataFrame, budget: float, repeats: float) -> DataFrame:
    """`target` of rows with `source_size` and `weight`: the budget by weight, at most `repeats` times
    the size, the excess going to the others by weight until none is above.

    Each round is one pass of sums over the sources; the driver sees two numbers a round. Rounds
    end when no more source is capped. Sources without weight or words get 0.
    """
    cap = F.col("source_size") * repeats
    level, capped = 0.0, -1
    while True:
        over = cap < F.col("weight") * level
        r = sizes.agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, cap)).alias("given"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
        ).first()
        if r["n"] == capped or not r["free"]:
            break
        capped, level = r["n"], (budget - (r["given"] or 0)) / r["free"]
    return sizes.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def mixed(docs: DataFrame, schedules: list[Knots], by_source: dict[str, Knots] | None = None, share: float = 1.0,
          repeats: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each document: `doc_id`, `source`, `size` (words), `source_size`, `target` (words of its
    source that the mix wants), `taken` (words of the document that it takes, repeats counted) and
    `passes`: array of (pass, time, words), the times at which training meets it.

    `schedules` go round the sources in the order of their names' code points, null last;
    `by_source` sets those of named sources. The budget is `share` of all words. A source's stream
    is cut at its target, so whole passes are equal for all its documents and at most one document
    is taken in part.

    Null texts have size 0; null ids are documents like others; empty ones are never taken; an
    empty table stays empty. Columns besides the three are not looked at. Rows that agree in id,
    source and text are counted before the shuffle and get places one after another, so results do
    not depend on how rows lie. A hot source is spread over many lots of its stream; what is
    gathered for one source is a sum for each lot.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    entries = written(
        rows.select("doc_id", "source", words.alias("size"), F.md5(name.cast("binary")).alias("order"),
                    F.spark_partition_id().alias("lot"))
        .groupBy("doc_id", "source", "size", "order", "lot").agg(F.count(F.lit(1)).alias("copies")), "mix-entries",
    )
    sums = entries.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("entries")
    )
    first = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.substring("source", 1, 2), F.lit("")))
    ranked = rank_within(sums, [], first, [F.col("source").isNull(), F.col("source")], "rank")
    turn = F.pmod(F.col("rank") - 1, F.lit(len(schedules)))
    chosen = _schedule(schedules[-1])
    for i, knots in enumerate(schedules[:-1]):
        chosen = F.when(turn == i, _schedule(knots)).otherwise(chosen)
    for known, knots in (by_source or {}).items():
        chosen = F.when(F.col("source") == known, _schedule(knots)).otherwise(chosen)
    sizes = written(ranked.withColumn("schedule", chosen).withColumn("weight", F.col("schedule.weight")), "mix-sources")
    total, most = sizes.agg(F.sum("source_size"), F.max("entries")).first()
    aims = targets(sizes, share * (total or 0), repeats)

    digits = max(1, math.ceil(math.log(max(1, (most or 0) / LOT), 16)))
    cut = entries.withColumn("piece", F.substring("order", 1, digits))
    lots = cut.groupBy("source", "piece").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    along = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = lots.withColumn("start", F.sum("words").over(along) - F.col("words"))
    known = aims.select(F.col("source").alias("_source"), "source_size", "target", "schedule")
    starts = starts.join(known, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), F.col("piece").alias("_piece"), "start", "source_size", "target", "schedule",
    )
    inside = Window.partitionBy("source", "piece").orderBy("order", "doc_id", "size", "lot").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    mass = F.col("size") * F.col("copies")
    placed = (
        cut.withColumn("before", F.sum(mass).over(inside) - mass)
        .join(starts, (F.col("piece") == F.col("_piece")) & F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", "size", "order", "source_size", "target", "schedule",
                (F.col("start") + F.col("before")).alias("first"),
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        .withColumn("place", F.col("first") + F.col("copy") * F.col("size"))
    )
    wanted = F.floor("target").cast("long")

    def one(i: Column) -> Column:
        at = i.cast("long") * F.col("source_size") + F.col("place")
        return F.struct(
            i.cast("int").alias("pass"), time_of(at, wanted, F.col("schedule")).alias("time"),
            F.least(F.col("size"), wanted - at).alias("words"),
        )

    begun = F.ceil((wanted - F.col("place")) / F.col("source_size")).cast("int")  # passes that reach this place
    passes = F.when(
        (F.col("size") > 0) & (wanted > F.col("place")), F.transform(F.sequence(F.lit(0), begun - 1), one)
    ).otherwise(F.array().cast("array<struct<pass:int,time:double,words:bigint>>"))
    done = placed.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return done.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", "order")


def training_order(mix: DataFrame) -> DataFrame:
    """The mix as training reads it: a row for each pass of each document (`doc_id`, `source`, `pass`,
    `time`, `words`), range-sorted by time; ties by the digest that ordered the streams."""
    return mix.select("doc_id", "source", "order", F.inline("passes")).orderBy("time", "order", "pass").drop("order")


def in_first_order(mix: DataFrame) -> DataFrame:
    """The mix's documents, range-sorted by the time training first meets them (`first_time`; null
    and last where it never does)."""
    first = mix.withColumn("first_time", F.get("passes", F.lit(0))["time"])
    return first.orderBy(F.col("first_time").asc_nulls_last(), "order")
