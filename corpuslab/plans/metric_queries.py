"""Scores of predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.config import KEYWORDS, LANGUAGE_ALIASES, LANGUAGES
from corpuslab.functions.arrays import GRAM_SEP, gram_keys, joined, let, ngrams
from corpuslab.functions.bleu import brevity_penalty
from corpuslab.functions.tables import literal_table
from corpuslab.functions.text import space_tokens
from corpuslab.operators import flow, reports, scores, trees
from corpuslab.operators.segments import clipped_overlap, keyword_mask, ref_tokens, seg_stats, token_weight
from corpuslab.plans.registry import query
from corpuslab.plans.tables import SIDE_WORDS, Tables, rewrite
from corpuslab.session import scratch_path
from corpuslab.sources.text import read_keywords


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def stats_of(t: Tables, order: int = 4, keywords: bool = False) -> DataFrame:
    return seg_stats(t.preds, max_order=order, keywords=SIDE_WORDS if keywords else None)


@query("tok_whitespace", r"""
    select model, idx, len(h)::bigint as tokens, array_to_string(h,'|') as joined from seg_tok""")
def tok_whitespace(t):
    tok = t.preds.select("model", "idx", space_tokens(F.col("hyp")).alias("h"))
    return tok.select("model", "idx", F.size("h").cast("bigint").alias("tokens"), joined(F.col("h"), "|").alias("joined"))


@query("ngram_counts", """
    select idx, n::bigint as n, replace(gram,chr(31),' ') as gram, cr::bigint as cnt from ref_grams where n<=4""")
def ngram_counts(t):
    tok = t.segments.select("idx", F.split("ref", " ").alias("w"))
    grams = F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("n"), F.expr(gram_keys("w", n)).alias("g")) for n in range(1, 5)
    ])
    return (
        tok.select("idx", F.inline(grams)).select("idx", "n", F.explode("g").alias("gram"))
        .groupBy("idx", "n", F.replace("gram", F.lit(GRAM_SEP), F.lit(" ")).alias("gram"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


@query("ngram_padded", """
    with p as (select idx, list_concat(list_concat(['<s>','<s>'], a), ['</s>','</s>']) as w from segments)
    select idx, i::bigint as pos, w[i]||' '||w[i+1]||' '||w[i+2] as gram from (
      select idx, w, unnest(range(1, len(w)-1)) as i from p)""")
def ngram_padded(t):
    grams = ngrams(F.split("ref", " "), 3, True, True, "<s>", "</s>")
    return t.segments.select("idx", F.posexplode(grams).alias("pos", "g")).select(
        "idx", (F.col("pos") + 1).cast("bigint").alias("pos"), F.array_join("g", " ").alias("gram")
    )


@query("kw_token_weights", """
    select idx, w as token, case when w in (select word from keywords) then 1.0::double else 0.2::double end as weight,
      count(*)::bigint as cnt from words group by all""")
def kw_token_weights(t):
    tok = t.segments.select("idx", F.explode(F.split("ref", " ")).alias("token"))
    return tok.groupBy("idx", "token").agg(F.count(F.lit(1)).alias("cnt")).select(
        "idx", "token", token_weight(F.col("token"), SIDE_WORDS).alias("weight"), "cnt"
    )


_KEYWORD_ROWS = ", ".join(f"('{lang}', '{w}')" for lang, words in KEYWORDS.items() for w in words)


@query("kw_files", f"""
    with k(lang, word) as (values {_KEYWORD_ROWS})
    select k.lang, k.word, count(w.w)::bigint as cnt from (select distinct * from k) k left join words w on w.w=k.word group by all""")
def kw_files(t):
    """How often each language's keywords occur, from one file of keywords a language."""
    base = scratch_path(t.spark, "keywords")
    for lang, words in KEYWORDS.items():
        literal_table(t.spark, ["value"], [(w,) for w in words]).write.text(f"{base}/{lang}")
    lists = reduce(DataFrame.unionByName, [read_keywords(t.spark, f"{base}/{lang}", lang) for lang in KEYWORDS]).distinct()
    counts = t.segments.select(F.explode(F.split("ref", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    return lists.join(counts, "word", "left").select("lang", "word", F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt"))


@query("kw_share_by_model", """
    select model, sum(len(h))::bigint as tokens,
      sum(len(list_filter(h, lambda x: list_contains(['the','of','and','in','le','der','que'], x))))::bigint as keywords
    from seg_tok group by model""")
def kw_share_by_model(t):
    tok = t.preds.select("model", space_tokens(F.col("hyp")).alias("h"))
    return tok.groupBy("model").agg(
        F.sum(F.size("h").cast("bigint")).alias("tokens"),
        F.sum(F.size(keyword_mask(F.col("h"), SIDE_WORDS)).cast("bigint")).alias("keywords"),
    )


@query("metric_exact_match", """
    select model, count(*)::bigint as n, sum(exact::int)::bigint as hits,
      round(100.0*sum(exact::int)/count(*),6)::double as exact_match from seg_tok group by model""")
def metric_exact_match(t):
    return scores.exact_match(
        t.preds.select("model", (F.trim("ref") == F.trim("hyp")).alias("exact")), ["model"]
    ).withColumn("exact_match", r6("exact_match"))


@query("metric_clipped_overlap", """
    with g as (select idx, ref_no, n, gram, count(*) as c from (
        select idx, ref_no, n, array_to_string(a[i:i+n-1],' ') as gram from (
          select idx, ref_no, a, n, unnest(range(1, len(a)-n+2)) as i from (
            select idx, ref_no, string_split(ref,' ') as a from multiref union all
            select distinct idx, -1, string_split(hyp,' ') from multiref)
          cross join (select unnest([1,2,3,4]) as n))) group by all),
      r as (select idx, n, gram, max(c) as c from g where ref_no>=0 group by all)
    select h.idx, h.n::bigint as n, sum(least(h.c, coalesce(r.c,0)))::bigint as matches, sum(h.c)::bigint as possible
    from g h left join r on r.idx=h.idx and r.n=h.n and r.gram=h.gram where h.ref_no=-1 group by all""")
def metric_clipped_overlap(t):
    tok = t.multiref.select("idx", space_tokens(F.col("hyp")).alias("h"), ref_tokens(F.col("refs")).alias("r"))
    per = F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("n"), clipped_overlap("h", "r", n).alias("matches"),
                 (F.size("h") - (n - 1)).cast("bigint").alias("possible"))
        for n in range(1, 5)
    ])
    return tok.select("idx", F.inline(per)).filter(F.col("possible") > 0)


@query("metric_bleu_corpus", "select model, round(bleu,6) as bleu from bleu_g")
def metric_bleu_corpus(t):
    return scores.corpus_bleu(stats_of(t), ["model"]).withColumn("bleu", r6("bleu"))


@query("metric_bleu_corpus_unsmoothed", """
    select model, round(exp(avg(ln(m/p))) * min(case when hl>rl then 1.0 else exp(1-rl/hl) end),6) as bleu
    from (select model, n, sum(m)::double as m, sum(p)::double as p from seg_orders where n<=4 group by all)
    join lens using (model) group by model""")
def metric_bleu_corpus_unsmoothed(t):
    return scores.corpus_bleu(stats_of(t), ["model"], smooth=False).withColumn("bleu", r6("bleu"))


MULTI = """
    with g as (select idx, ref_no, n, gram, count(*) as c from (
        select idx, ref_no, n, array_to_string(a[i:i+n-1],' ') as gram from (
          select idx, ref_no, a, n, unnest(range(1, len(a)-n+2)) as i from (
            select idx, ref_no, string_split(ref,' ') as a from multiref union all
            select distinct idx, -1, string_split(hyp,' ') from multiref)
          cross join (select unnest([1,2,3,4]) as n))) group by all),
      r as (select idx, n, gram, max(c) as c from g where ref_no>=0 group by all),
      o as (select h.n, sum(least(h.c, coalesce(r.c,0)))::double as m, sum(h.c)::double as p
        from g h left join r on r.idx=h.idx and r.n=h.n and r.gram=h.gram where h.ref_no=-1 group by h.n),
      l as (select idx, len(string_split(hyp,' ')) as hl, len(string_split(ref,' ')) as rl from multiref),
      s as (select idx, min(hl) as hl, min(rl) as short, arg_min(rl, abs(rl-hl)*100000+rl) as close from l group by idx)
"""


@query("metric_bleu_multiref", MULTI + """
    select count(*)::bigint as n, round(any_value(gm) * case when sum(hl)>sum(short) then 1.0
      else exp(1-sum(short)::double/sum(hl)) end, 6) as bleu
    from s cross join (select exp(avg(ln((m+1)/(p+1)))) as gm from o)""")
def metric_bleu_multiref(t):
    stats = seg_stats(t.multiref, refs="refs")
    sums = scores.corpus_sums(stats.withColumn("model", F.lit("drop11")), ["model"])
    return sums.select("n", r6(scores.bleu_from_sums(sums)).alias("bleu"))


@query("metric_closest_ref_len", """
    select idx, min(hl)::bigint as hyp_len, arg_min(rl, abs(rl-hl)*100000+rl)::bigint as close_ref_len, min(rl)::bigint as short_ref_len
    from (select idx, len(string_split(hyp,' ')) as hl, len(string_split(ref,' ')) as rl from multiref) group by idx""")
def metric_closest_ref_len(t):
    return seg_stats(t.multiref, refs="refs").select("idx", "hyp_len", "close_ref_len", "short_ref_len")


@query("refs_assemble", """
    select idx, count(*)::bigint as refs, string_agg(ref, '||' order by ref_no) as joined from multiref group by idx""")
def refs_assemble(t):
    from corpuslab.operators.references import assemble_references

    files = [t.multiref.select("idx", F.get("refs", F.lit(i)).alias("ref")) for i in range(3)]
    return assemble_references(files).select(
        "idx", F.size("refs").cast("bigint").alias("refs"), F.array_join("refs", "||").alias("joined")
    )


@query("metric_bleu_segment", "select model, idx, round(100*bleu,6) as bleu from seg_bleu_g")
def metric_bleu_segment(t):
    return stats_of(t).select("model", "idx", r6(scores.segment_bleu() * 100).alias("bleu"))


@query("metric_nbleu_corpus", "select model, round(bleu,6) as bleu from bleu_n")
def metric_nbleu_corpus(t):
    return scores.corpus_nbleu(stats_of(t), ["model"]).withColumn("bleu", r6("bleu"))


@query("metric_nbleu_5gram", """
    select model, round(exp(sum(0.2*ln(case when m=0 then 0.1/p else m/p end))) *
      min(case when hl>rl then 1.0 else exp(1-rl/hl) end),6) as bleu
    from (select model, n, sum(m)::double as m, sum(greatest(1,p))::double as p from seg_orders group by all)
    join lens using (model) group by model""")
def metric_nbleu_5gram(t):
    return scores.corpus_nbleu(stats_of(t, 5), ["model"], weights=[0.2] * 5).withColumn("bleu", r6("bleu"))


@query("metric_nbleu_segment", "select model, idx, round(bleu,6) as bleu from seg_bleu_n")
def metric_nbleu_segment(t):
    return stats_of(t).select("model", "idx", r6(scores.segment_nbleu()).alias("bleu"))


@query("metric_nbleu_multiref", MULTI + """
    select count(*)::bigint as n, round(any_value(gm) * case when sum(hl)>sum(close) then 1.0
      else exp(1-sum(close)::double/sum(hl)) end, 6) as bleu
    from s cross join (select exp(sum(0.25*ln(m/p))) as gm from (
      select n, m, p + (select count(*) from s where hl<n) as p from o))""")
def metric_nbleu_multiref(t):
    stats = seg_stats(t.multiref, refs="refs").withColumn("model", F.lit("drop11"))
    n = stats.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return scores.corpus_nbleu(stats, ["model"]).join(n, "model").select("n", r6("bleu").alias("bleu"))


@query("metric_modified_precision", """
    select model, idx, n::bigint as n, m::bigint as num, greatest(1,p)::bigint as den from seg_orders where n<=4""")
def metric_modified_precision(t):
    return scores.modified_precision(stats_of(t), ["model", "idx"])


@query("metric_brevity_penalty", """
    select model, idx, len(h)::bigint as hyp_len, len(r)::bigint as close_ref_len,
      round(case when len(h)>len(r) then 1.0 when len(h)=0 then 0.0 else exp(1-len(r)::double/len(h)) end,6) as brevity_penalty
    from seg_tok""")
def metric_brevity_penalty(t):
    return scores.penalty_table(stats_of(t), ["model", "idx", "hyp_len"]).withColumn(
        "brevity_penalty", r6("brevity_penalty")
    )


# -- smoothing: per segment, sums of logs over the four orders ----------------------------
_ORDERS = """
    with o as (select model, idx, n, m::double as m, greatest(1,p)::double as d, p, hl, rl,
        case when hl>rl then 1.0 when hl=0 then 0.0 else exp(1-rl::double/hl) end as bp,
        max(case when n=1 then m end) over (partition by model, idx) as hits1,
        sum(case when m=0 then 1 else 0 end) over (partition by model, idx order by n) as empty_so_far
      from seg_orders where n<=4)
    select model, idx, round(case when min(hits1)=0 then 0.0 else min(bp)*exp(sum(0.25*ln({p}))) end,6) as bleu
    from o group by all"""
_WIDE = """
    with w as (select model, idx, min(hl)::double as hl, min(rl)::double as rl,
        max(case when n=1 then m end)::double as m1, max(case when n=2 then m end)::double as m2,
        max(case when n=3 then m end)::double as m3, max(case when n=4 then m end)::double as m4,
        max(case when n=5 then m end)::double as m5,
        greatest(1,max(case when n=1 then p end))::double as d1, greatest(1,max(case when n=2 then p end))::double as d2,
        greatest(1,max(case when n=3 then p end))::double as d3, greatest(1,max(case when n=4 then p end))::double as d4,
        greatest(1,max(case when n=5 then p end))::double as d5 from seg_orders group by all),
      q as (select *, case when hl>rl then 1.0 when hl=0 then 0.0 else exp(1-rl/hl) end as bp, {p}, m5/d5 as p5 from w)"""
_RAW = "m1/d1 as p1, m2/d2 as p2, m3/d3 as p3, m4/d4 as p4"
_METHOD4 = ", ".join(
    f"case when m{i}=0 then ({i - 1}+5/nullif(ln(hl),0))/d{i} else m{i}/d{i} end as p{i}" for i in range(1, 5)
)
_NEIGHBOURS = """,
      a as (select *, (p1+1+p1+p2)/3 as q1 from q), b as (select *, (q1+p2+p3)/3 as q2 from a),
      c as (select *, (q2+p3+p4)/3 as q3 from b), e as (select *, (q3+p4+p5)/3 as q4 from c)
    select model, idx, round(case when m1=0 then 0.0 else bp*exp(0.25*(ln(q1)+ln(q2)+ln(q3)+ln(q4))) end,6) as bleu from e"""
SMOOTH_SQL = {
    "m0": _ORDERS.format(p="case when m=0 then 2.2250738585072014e-308 else m/d end"),
    "m1": _ORDERS.format(p="case when m=0 then 0.1/d else m/d end"),
    "m2": _ORDERS.format(p="(m+1)/(d+1)"),
    "m3": _ORDERS.format(p="case when m=0 then 1.0/(pow(2.0,empty_so_far)*d) else m/d end"),
    "m4": _ORDERS.format(p="case when m=0 then (n-1+5/nullif(ln(hl),0))/d else m/d end"),
    "m5": _WIDE.format(p=_RAW) + _NEIGHBOURS,
    "m6": _WIDE.format(p=_RAW) + """,
      a as (select *, (m3+5*case when p1=0 then 0 else p2*p2/p1 end)/(greatest(hl-2,0)+5) as q3 from q),
      b as (select *, (m4+5*case when p2=0 then 0 else q3*q3/p2 end)/(greatest(hl-3,0)+5) as q4 from a)
    select model, idx, round(case when m1=0 then 0.0 when m3=0 then null
      else bp*exp(0.25*(ln(p1)+ln(p2)+ln(q3)+ln(q4))) end,6) as bleu from b""",
    "m7": _WIDE.format(p=_METHOD4) + _NEIGHBOURS,
}


def _register_smoothing(kind: str) -> None:
    @query(f"metric_smooth_{kind}", SMOOTH_SQL[kind])
    def smoothed(t):
        stats = stats_of(t, 5 if kind in ("m5", "m7") else 4)
        return stats.select("model", "idx", r6(scores.segment_nbleu(kind)).alias("bleu"))


for _kind in SMOOTH_SQL:
    _register_smoothing(_kind)


@query("metric_auto_reweigh", """
    select model, idx, round(case when max(case when n=1 then m end)=0 then 0.0 else
      min(case when hl>rl then 1.0 when hl=0 then 0.0 else exp(1-rl::double/hl) end) *
      exp(sum(case when hl>=4 then 0.25 when n<=hl then 1.0/hl else 0.0 end *
        ln(case when m=0 then 0.1/greatest(1,p) else m::double/greatest(1,p) end))) end,6) as bleu
    from seg_orders where n<=4 group by all""")
def metric_auto_reweigh(t):
    return stats_of(t).select("model", "idx", r6(scores.segment_nbleu("m1", auto_reweigh=True)).alias("bleu"))


@query("metric_weighted_recall", "select model, round(weighted_recall,6) as weighted_recall from recall")
def metric_weighted_recall(t):
    return scores.weighted_recall(stats_of(t, keywords=True), ["model"]).withColumn(
        "weighted_recall", r6("weighted_recall"))


@query("metric_weighted_recall_strict", "select model, round(strict_recall,6) as weighted_recall from recall")
def metric_weighted_recall_strict(t):
    return scores.weighted_recall(stats_of(t, keywords=True), ["model"], strict_ref_len=True).withColumn(
        "weighted_recall", r6("weighted_recall"))


@query("metric_weighted_smooth_m2", "select model, round(recall_m2,6) as weighted_recall from recall")
def metric_weighted_smooth_m2(t):
    return scores.weighted_recall(stats_of(t, keywords=True), ["model"], "m2").withColumn(
        "weighted_recall", r6("weighted_recall"))


@query("metric_weighted_segment", "select model, idx, round(weighted_recall,6) as weighted_recall from seg_recall")
def metric_weighted_segment(t):
    return stats_of(t, keywords=True).select(
        "model", "idx", r6(scores.segment_weighted_recall()).alias("weighted_recall"))


def syntax_of(t: Tables) -> DataFrame:
    return trees.syntax_match(t.preds.select("model", "idx"), trees.subtrees(t.nodes, digests=True))


def flow_of(t: Tables) -> DataFrame:
    return flow.straight_match(t.preds.select("model", "idx"), t.occ)


#: Two of the texts as references of the others.
REFERENCES = ["ref", "sub9"]


def _judged(t: Tables) -> DataFrame:
    return t.preds.select("model", "idx").filter(~F.col("model").isin(REFERENCES))


def _summed(hits: DataFrame, name: str) -> DataFrame:
    sums = hits.groupBy("model").agg(F.sum("total").alias("total"), F.sum("hit").alias("hit"))
    return sums.withColumn(name, r6(F.col("hit") / F.col("total")))


@query("metric_syntax_multiref", """
    with r as (select ex, sexp, count(*) as cnt from subtrees where side in ('ref','sub9') group by all),
    t as (select ex, sum(cnt) as total from r group by ex),
    d as (select distinct ex, side, sexp from subtrees where side not in ('ref','sub9')),
    m as (select d.side, d.ex, sum(cnt) as hit from r join d on d.ex=r.ex and d.sexp=r.sexp group by all)
    select p.model, sum(coalesce(t.total,0))::bigint as total, sum(coalesce(m.hit,0))::bigint as hit,
      round(sum(coalesce(m.hit,0))::double/sum(t.total),6) as syntax from preds p
    left join t on t.ex=p.idx left join m on m.ex=p.idx and m.side=p.model where p.model<>'sub9' group by p.model""")
def metric_syntax_multiref(t):
    return _summed(trees.syntax_match(_judged(t), trees.subtrees(t.nodes, digests=True), REFERENCES), "syntax")


@query("metric_dataflow_multiref", """
    with r as (select * from flow_bag where side in ('ref','sub9')),
    t as (select ex, sum(cnt) as total from r group by ex),
    m as (select d.side, d.ex, sum(least(r.cnt, d.cnt)) as hit from r join flow_bag d on d.ex=r.ex and d.edge=r.edge
      where d.side not in ('ref','sub9') group by all)
    select p.model, sum(coalesce(t.total,0))::bigint as total, sum(coalesce(m.hit,0))::bigint as hit,
      round(sum(coalesce(m.hit,0))::double/sum(t.total),6) as flow from preds p
    left join t on t.ex=p.idx left join m on m.ex=p.idx and m.side=p.model where p.model<>'sub9' group by p.model""")
def metric_dataflow_multiref(t):
    return _summed(flow.straight_match(_judged(t), t.occ, REFERENCES), "flow")


@query("metric_codebleu_multiref", """
    with two as (select idx, list_filter(string_split(ref,' '), lambda x: x<>'') as r from (select distinct idx, ref from preds
        union all select idx, hyp from preds where model='sub9')),
    h as (select model, idx, list_filter(string_split(hyp,' '), lambda x: x<>'') as h from preds where model<>'sub9'),
    rg as (select idx, k, n, array_to_string(r[i:i+n-1],chr(31)) as gram, count(*) as c from (
        select *, unnest(range(1, len(r)-n+2)) as i from (select *, row_number() over (partition by idx) as k from two)
        cross join (select unnest([1,2,3,4]) as n)) group by all),
    hg as (select model, idx, n, array_to_string(h[i:i+n-1],chr(31)) as gram, count(*) as c from (
        select *, unnest(range(1, len(h)-n+2)) as i from h cross join (select unnest([1,2,3,4]) as n)) group by all),
    best as (select idx, n, gram, max(c) as c from rg group by all),
    m as (select hg.model, hg.n, sum(least(hg.c, coalesce(best.c,0)))::double as m from hg left join best using (idx, n, gram) group by all),
    span as (select model, count(*)::double as segs, sum(len(h))::double as hl, sum(near)::double as rl from (
        select h.model, h.idx, any_value(h) as h, arg_min(len(r), abs(len(r)-len(h))*100000+len(r)) as near from h join two using (idx) group by all) group by model),
    p as (select model, n, sum(greatest(1, len(h)-n+1))::double as p from h cross join (select unnest([1,2,3,4]) as n) group by all),
    bleu as (select model, exp(sum(0.25*ln(case when m=0 then 0.1/p else m/p end))) * min(case when hl>rl then 1.0 else exp(1-rl/hl) end) as s
      from m join p using (model, n) join span using (model) group by model),
    wt as (select *, case when n=1 and gram not in (select word from keywords) then 0.2 else 1.0 end as w from rg),
    den as (select idx, k, n, greatest(1, sum(c*w)) as den from wt group by all),
    every as (select idx, k, n, coalesce(den, 1) as den from (select *, row_number() over (partition by idx) as k from two) cross join (select unnest([1,2,3,4]) as n)
      left join den using (idx, k, n)),
    num as (select hg.model, hg.n, sum(w*least(wt.c, hg.c)) as num from hg join wt using (idx, n, gram) group by all),
    dens as (select h.model, e.n, sum(e.den) as den from h join every e using (idx) group by all),
    rec as (select model, exp(sum(0.25*ln(case when coalesce(num,0)=0 then 0.1/den else num/den end))) * min(case when hl>2*segs then 1.0 else exp(1-2*segs/hl) end) as s
      from dens left join num using (model, n) join span using (model) group by model),
    sr as (select ex, sexp, count(*) as cnt from subtrees where side in ('ref','sub9') group by all),
    st as (select ex, sum(cnt) as total from sr group by ex),
    sm as (select d.side, d.ex, sum(cnt) as hit from sr join (select distinct ex, side, sexp from subtrees where side not in ('ref','sub9')) d using (ex, sexp) group by all),
    fr as (select * from flow_bag where side in ('ref','sub9')),
    ft as (select ex, sum(cnt) as total from fr group by ex),
    fm as (select d.side, d.ex, sum(least(fr.cnt, d.cnt)) as hit from fr join flow_bag d on d.ex=fr.ex and d.edge=fr.edge where d.side not in ('ref','sub9') group by all),
    parts as (select h.model, sum(coalesce(sm.hit,0))::double/sum(coalesce(st.total,0)) as syn, sum(coalesce(fm.hit,0))::double/sum(coalesce(ft.total,0)) as flo from h
      left join st on st.ex=h.idx left join sm on sm.ex=h.idx and sm.side=h.model left join ft on ft.ex=h.idx left join fm on fm.ex=h.idx and fm.side=h.model group by h.model)
    select model, round(0.25*bleu.s+0.25*rec.s+0.25*syn+0.25*flo,6) as code_bleu from bleu join rec using (model) join parts using (model)""")
def metric_codebleu_multiref(t):
    """All four parts against two references of each segment."""
    words = F.split("ref", " ")
    second = let(words, lambda w: rewrite(w, F.col("idx"), "sub9"))
    segments = t.preds.filter(~F.col("model").isin(REFERENCES)).withColumn("refs", F.array("ref", second)).drop("ref")
    stats = seg_stats(segments, refs="refs", keywords=SIDE_WORDS)
    syntax = trees.syntax_match(_judged(t), trees.subtrees(t.nodes, digests=True), REFERENCES)
    edges = flow.straight_match(_judged(t), t.occ, REFERENCES)
    return reports.code_bleu(stats, syntax, edges, ["model"]).select("model", r6("code_bleu").alias("code_bleu"))


@query("metric_syntax_match", """
    select model, sum(total)::bigint as total, sum(hit)::bigint as hit, round(sum(hit)::double/sum(total),6) as syntax
    from syntax group by model""")
def metric_syntax_match(t):
    hits = syntax_of(t)
    sums = hits.groupBy("model").agg(F.sum("total").alias("total"), F.sum("hit").alias("hit"))
    return sums.withColumn("syntax", r6(F.col("hit") / F.col("total")))


@query("metric_dataflow_match", """
    select model, sum(total)::bigint as total, sum(hit)::bigint as hit,
      round(case when sum(total)=0 then 0.0 else sum(hit)::double/sum(total) end,6) as flow from dataflow group by model""")
def metric_dataflow_match(t):
    hits = flow_of(t)
    sums = hits.groupBy("model").agg(F.sum("total").alias("total"), F.sum("hit").alias("hit"))
    return sums.withColumn("flow", r6(F.coalesce(F.try_divide("hit", "total"), F.lit(0.0))))


@query("metric_codebleu", "select model, round(code_bleu,6) as code_bleu from code_bleu")
def metric_codebleu(t):
    out = reports.code_bleu(stats_of(t, keywords=True), syntax_of(t), flow_of(t), ["model"])
    return out.select("model", r6("code_bleu").alias("code_bleu"))


@query("metric_codebleu_segment", "select model, idx, round(code_bleu,6) as code_bleu from seg_code_bleu")
def metric_codebleu_segment(t):
    out = reports.segment_code_bleu(stats_of(t, keywords=True), syntax_of(t), flow_of(t))
    return out.select("model", "idx", r6("code_bleu").alias("code_bleu"))


@query("metric_codebleu_weights", """
    select b.model, round(0.1*b.bleu+0.4*w.weighted_recall+0.4*s.syntax+0.1*d.flow,6) as code_bleu from bleu_n b
    join recall w using (model)
    join (select model, sum(hit)::double/sum(total) as syntax from syntax group by model) s using (model)
    join (select model, sum(hit)::double/sum(total) as flow from dataflow group by model) d using (model)""")
def metric_codebleu_weights(t):
    out = reports.code_bleu(stats_of(t, keywords=True), syntax_of(t), flow_of(t), ["model"],
                            **scores.parse_weights("0.1,0.4,0.4,0.1"))
    return out.select("model", r6("code_bleu").alias("code_bleu"))


@query("lang_resolve", """
    select source, lang, case when lang in ('java','javascript','c_sharp','php','go','python','ruby') then lang
      when lang='js' then 'javascript' end as resolved, count(*)::bigint as docs
    from (select source, case when source in ('src0','src3') then 'js' when source in ('src1','src5') then 'java'
      when source='src2' then 'javascript' when source='src4' then 'c_sharp' else lang end as lang from documents) group by all""")
def lang_resolve(t):
    named = F.when(F.col("source").isin("src0", "src3"), "js").when(F.col("source").isin("src1", "src5"), "java")
    named = named.when(F.col("source") == "src2", "javascript").when(F.col("source") == "src4", "c_sharp")
    docs = t.documents.select("source", named.otherwise(F.col("lang")).alias("lang"))
    known = literal_table(
        t.spark, ["lang", "resolved"], [(x, x) for x in LANGUAGES] + list(LANGUAGE_ALIASES.items())
    )
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs")).join(known, "lang", "left").select(
        "source", "lang", "resolved", "docs")
