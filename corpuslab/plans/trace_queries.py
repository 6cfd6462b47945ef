"""Decode traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import trace
from corpuslab.plans.metric_queries import r6
from corpuslab.plans.registry import query

STEP = ["ex", "step"]


def weights(t):
    return t.weights


def covered(t):
    return t.covered


def lines(t):
    return trace.line_weights(weights(t))


@query("trace_masked_softmax", "select ex, step, src, round(weight,6) as weight from weights")
def trace_masked_softmax(t):
    return weights(t).select(*STEP, "src", r6("weight").alias("weight"))


@query("trace_softmax_total", """
    select ex, step, count(*)::bigint as sources, round(sum(weight),6) as total from weights group by all""")
def trace_softmax_total(t):
    return weights(t).groupBy(*STEP).agg(
        F.count(F.lit(1)).alias("sources"), r6(F.sum("weight")).alias("total")
    )


@query("trace_context_vector", """
    with s as (select vec_id, label, embedding, embedding[1]::double as z from embeddings),
    w as (select label, embedding, exp(z-m)/sum(exp(z-m)) over (partition by label) as weight from (
      select *, max(z) over (partition by label) as m from s)),
    l as (select label, weight, generate_subscripts(embedding,1)-1 as dim, unnest(embedding)::double as v from w)
    select label::bigint as label, dim::bigint as dim, round(sum(weight*v),6) as value from l group by all""")
def trace_context_vector(t):
    vectors = t.read("embeddings").select(
        F.col("label").cast("bigint").alias("label"), "embedding", F.get("embedding", F.lit(0)).cast("double").alias("score"),
        F.lit(0).alias("mask"),
    )
    weighted = trace.masked_softmax(vectors, ["label"])
    return trace.context_vectors(weighted, ["label"], "embedding").select(
        "label", F.col("dim").cast("bigint").alias("dim"), r6("value").alias("value")
    )


@query("trace_coverage", "select ex, step, src, round(coverage,6) as coverage from coverage")
def trace_coverage(t):
    return covered(t).select(*STEP, "src", r6("coverage").alias("coverage"))


@query("trace_coverage_penalty", """
    select ex, step, round(sum(least(coverage,weight)),6) as penalty, max(y_mask)::int as y_mask from coverage group by all""")
def trace_coverage_penalty(t):
    return trace.coverage_penalty(covered(t)).select(*STEP, r6("penalty").alias("penalty"), "y_mask")


@query("trace_mean_coverage_penalty", """
    select round(sum(p*(1-y))/sum(1-y),6) as penalty from (
      select ex, step, sum(least(coverage,weight)) as p, max(y_mask) as y from coverage group by all)""")
def trace_mean_coverage_penalty(t):
    pen = trace.coverage_penalty(covered(t)).withColumn("run", F.lit(0))
    return trace.mean_penalty(pen, ["run"]).select(r6("penalty").alias("penalty"))


TOP = """
    with top as (select *, row_number() over (partition by ex, step order by round(weight,9) desc, src) as rank from coverage)
"""


def _top(t, df):
    # nine digits: the same ties in both systems
    return trace.top_sources(df, digits=9)


@query("trace_topk_sources", TOP + "select ex, step, src, rank, round(weight,6) as weight from top where rank<=10")
def trace_topk_sources(t):
    return _top(t, weights(t)).select(*STEP, "src", F.col("rank").cast("bigint").alias("rank"), r6("weight").alias("weight"))


@query("trace_topk_lines", """
    with l as (select ex, step, line_no, sum(weight) as weight from weights group by all),
    r as (select *, row_number() over (partition by ex, step order by round(weight,9) desc, line_no) as rank from l)
    select ex, step, line_no, rank, round(weight,6) as weight from r where rank<=10""")
def trace_topk_lines(t):
    top = trace.top_sources(lines(t), source="line_no", digits=9)
    return top.select(*STEP, "line_no", F.col("rank").cast("bigint").alias("rank"), r6("weight").alias("weight"))


@query("trace_gather_topk", TOP + """
    select ex, step, src, round(case when rank<=10 then coverage+weight else coverage end,6) as coverage_after from top""")
def trace_gather_topk(t):
    cov = covered(t)
    out = trace.gather_and_write_back(cov, _top(t, weights(t)))
    return out.select(*STEP, "src", r6("coverage_after").alias("coverage_after"))


def mixture(t):
    return trace.copy_mixture(t.dist, weights(t))


@query("trace_copy_mixture", "select ex, step, id, round(p,6) as p from mixture")
def trace_copy_mixture(t):
    return mixture(t).select(*STEP, "id", r6("p").alias("p"))


@query("trace_greedy_decode", """
    select ex, step, id, round(p,6) as p from (
      select *, row_number() over (partition by ex, step order by round(p,9) desc, id) as rn from mixture) where rn=1""")
def trace_greedy_decode(t):
    return trace.greedy(mixture(t), digits=9).select(*STEP, "id", r6("p").alias("p"))


def targets(t):
    return t.attn.groupBy(*STEP).agg(F.max("y_true").alias("y_true"), F.max("y_mask").alias("y_mask"))


LOSS = """
    with truth as (select a.ex, a.step, a.y_mask, coalesce(m.p,0) as p from (select distinct ex, step, y_true, y_mask from attn) a
      left join mixture m on m.ex=a.ex and m.step=a.step and m.id=a.y_true),
    nll as (select ex, sum(-ln(p+1e-10)*(1-y_mask))/nullif(sum(1-y_mask),0) as nll from truth group by ex)
"""


@query("trace_masked_nll", LOSS + "select ex, round(nll,6) as nll from nll")
def trace_masked_nll(t):
    return trace.masked_nll(mixture(t), targets(t), ["ex"]).select("ex", r6("nll").alias("nll"))


@query("trace_total_loss", LOSS + """,
    w as (select ex, step, sum(least(coverage,weight)) as p, max(y_mask) as y from coverage group by all),
    lw as (select ex, step, line_no, sum(weight) as weight, max(y_mask) as y from weights group by all),
    lc as (select *, coalesce(sum(weight) over (partition by ex, line_no order by step rows between unbounded preceding and 1 preceding),0) as coverage from lw),
    l as (select ex, step, sum(least(coverage,weight)) as p, max(y) as y from lc group by all),
    wp as (select ex, sum(p*(1-y))/nullif(sum(1-y),0) as p from w group by ex),
    lp as (select ex, sum(p*(1-y))/nullif(sum(1-y),0) as p from l group by ex)
    select ex, round(nll,6) as nll, round(lp.p,6) as line_penalty, round(wp.p,6) as word_penalty, round(nll+lp.p+wp.p,6) as loss
    from nll join wp using (ex) join lp using (ex)""")
def trace_total_loss(t):
    w = weights(t)
    word = trace.mean_penalty(trace.coverage_penalty(covered(t)), ["ex"], "word_penalty")
    by_line = trace.coverage(trace.line_weights(w), ["line_no"])
    line = trace.mean_penalty(trace.coverage_penalty(by_line), ["ex"], "line_penalty")
    nll = trace.masked_nll(trace.copy_mixture(t.dist, w), targets(t), ["ex"])
    out = trace.total_loss(nll, line, word, ["ex"])
    return out.select("ex", *[r6(c).alias(c) for c in ("nll", "line_penalty", "word_penalty", "loss")])


@query("trace_forced_copy_weights", """
    with c as (select ex, step, src, line_no, mask, coverage-mask*1e9 as cz from coverage),
    s as (select *, exp(cz-cm)/sum(exp(cz-cm)) over (partition by ex, step) as soft, count(*) over (partition by ex, step) as n from (
      select *, max(cz) over (partition by ex, step) as cm from c)),
    l as (select ex, step, line_no, sum(weight) as lw from weights group by all)
    select s.ex, s.step, s.src, round((1-mask-soft)/nullif(n-1,0)*lw,6) as copy_weight from s join l using (ex, step, line_no)""")
def trace_forced_copy_weights(t):
    w = weights(t)
    out = trace.forced_copy_weights(covered(t), trace.line_weights(w))
    return out.select(*STEP, "src", r6("copy_weight").alias("copy_weight"))


@query("trace_forced_copy_sample", """
    with c as (select ex, step, src, ext_id, line_no, mask, coverage-mask*1e9 as cz from coverage),
    s as (select *, exp(cz-cm)/sum(exp(cz-cm)) over (partition by ex, step) as soft, count(*) over (partition by ex, step) as n from (
      select *, max(cz) over (partition by ex, step) as cm from c)),
    l as (select ex, step, line_no, sum(weight) as lw from weights group by all),
    w as (select s.ex, s.step, s.src, s.ext_id, (1-mask-soft)/nullif(n-1,0)*lw as cw from s join l using (ex, step, line_no)),
    d as (select *, ln(cw)-ln(-ln((('0x'||substr(md5(ex||'|'||step||'|'||src||'|11'),1,13))::bigint+0.5)/4503599627370496.0)) as key from w where cw>0),
    k as (select *, row_number() over (partition by ex, step order by key desc) as r from d)
    select ex, step, src, ext_id, case when (('0x'||substr(md5(ex||'|'||step||'|12'),1,13))::bigint+0.5)/4503599627370496.0 >= 0.6
      then round(cw,6) else 0.0 end as loss_weight from k where r=1""")
def trace_forced_copy_sample(t):
    """One seeded draw per step."""
    w = weights(t)
    out = trace.forced_copy_weights(covered(t), trace.line_weights(w))
    drawn = trace.sample_forced_copy(out, seed=11)
    return drawn.withColumn("loss_weight", r6("loss_weight"))
