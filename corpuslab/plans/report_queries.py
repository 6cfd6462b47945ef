"""Reports, run analytics and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import reports, runs, scores
from corpuslab.plans.metric_queries import flow_of, r6, stats_of, syntax_of
from corpuslab.plans.registry import query
from corpuslab.plans.tables import MODELS
from corpuslab.session import scratch_path
from corpuslab.sources import text
from corpuslab.streaming import scores as streaming


@query("report_model_table", """
    select b.model, round(100*b.bleu,2) as bleu, e.exact_match, round(100*c.code_bleu,2) as code_bleu from bleu_g b
    join (select model, round(100.0*sum(exact::int)/count(*),2)::double as exact_match from seg_tok group by model) e using (model)
    join code_bleu c using (model)""")
def report_model_table(t):
    return reports.model_table(stats_of(t, keywords=True), syntax_of(t), flow_of(t), ["model"])


@query("report_model_scores", """
    select b.model, round(100*b.bleu,2) as bleu, e.exact_match from bleu_g b
    join (select model, round(100.0*sum(exact::int)/count(*),2)::double as exact_match from seg_tok group by model) e using (model)""")
def report_model_scores(t):
    return reports.model_scores(stats_of(t), ["model"])


def _curve_sql(length: str, grid: str) -> str:
    return f"""
    with s as (select model, idx, least({length}//20,10) as bucket, 100*bleu as bleu from seg_bleu_g),
    c as (select s.*, 100*k.code_bleu as code_bleu from s join seg_code_bleu k using (model, idx)),
    g as (select m.model, b.bucket from (select distinct model from s) m cross join (select unnest(range({grid})) as bucket) b)
    select g.model, g.bucket::bigint as bucket, count(c.idx)::bigint as segments, round(coalesce(avg(c.bleu),0),6) as bleu,
      round(coalesce(avg(c.code_bleu),0),6) as code_bleu from g left join c on c.model=g.model and c.bucket=g.bucket group by all"""


def _scored(t):
    rows = reports.segment_code_bleu(stats_of(t, keywords=True), syntax_of(t), flow_of(t))
    return rows.select(
        "model", "hyp_len", F.col("short_ref_len").alias("src_len"), (scores.segment_bleu() * 100).alias("bleu"),
        (F.col("code_bleu") * 100).alias("code_bleu"),
    )


def _curve(df):
    return df.withColumns({"bleu": r6("bleu"), "code_bleu": r6("code_bleu")})


@query("report_by_input_length", _curve_sql("rl", "(select max(bucket)+1 from s)"))
def report_by_input_length(t):
    return _curve(reports.scores_by_length(_scored(t), F.col("src_len"), ["bleu", "code_bleu"]))


@query("report_by_output_length", _curve_sql("hl", "11"))
def report_by_output_length(t):
    return _curve(reports.scores_by_length(_scored(t), F.col("hyp_len"), ["bleu", "code_bleu"], full_grid=True))


@query("report_length_series", """
    with s as (select model, least(hl//20,10) as bucket, 100*bleu as bleu from seg_bleu_g),
    g as (select m.model, b.bucket from (select distinct model from s) m cross join (select unnest(range(11)) as bucket) b),
    c as (select g.model, g.bucket, round(coalesce(avg(s.bleu),0),6) as bleu from g left join s using (model, bucket) group by all)
    select bucket::bigint as bucket, case when bucket=10 then '>200' else ((bucket+1)*20)::varchar end as label,
      max(bleu) filter (model='drop5') as drop5, max(bleu) filter (model='drop11') as drop11, max(bleu) filter (model='drop97') as drop97,
      max(bleu) filter (model='sub9') as sub9, max(bleu) filter (model='dup13') as dup13 from c group by bucket""")
def report_length_series(t):
    rows = stats_of(t).select("model", "hyp_len", (scores.segment_bleu() * 100).alias("bleu"))
    curve = reports.scores_by_length(rows, F.col("hyp_len"), ["bleu"], full_grid=True)
    return reports.length_series(curve.withColumn("bleu", r6("bleu")), "bleu", MODELS)


@query("report_rater_means", """
    select event_type as model, case when event_id%2=0 then 'syntax' else 'semantics' end as dimension,
      count(distinct user_id%5)::bigint as raters, round(avg(value),2) as mean_score from events group by all""")
def report_rater_means(t):
    ratings = t.read("events").select(
        F.col("event_type").alias("model"), F.when(F.col("event_id") % 2 == 0, "syntax").otherwise("semantics").alias("dimension"),
        (F.col("user_id") % 5).alias("rater"), F.col("value").alias("score"),
    )
    return reports.rater_means(ratings, ["model", "dimension"])


@query("report_side_by_side", """
    select idx, min(ref) as ref, max(hyp) filter (model='drop5') as drop5, max(hyp) filter (model='drop11') as drop11,
      max(hyp) filter (model='drop97') as drop97, max(hyp) filter (model='sub9') as sub9, max(hyp) filter (model='dup13') as dup13
    from preds group by idx""")
def report_side_by_side(t):
    return reports.side_by_side_rows(t.preds, MODELS)


# -- runs --------------------------------------------------------------------------------------

@query("log_parse", """
    select run, epoch, round(train_loss,6)::double as train_loss, round(valid_loss,6)::double as valid_loss from runlog""")
def log_parse(t):
    lines = t.runlog.select("run", "epoch", F.concat_ws(" ", "train_loss", "valid_loss").alias("line"))
    return runs.parse_log_lines(lines).withColumns({"train_loss": r6("train_loss"), "valid_loss": r6("valid_loss")})


@query("log_files", """
    select 'run='||run as run, epoch, round(train_loss,6)::double as train_loss, round(valid_loss,6)::double as valid_loss from runlog""")
def log_files(t):
    """One log file below a folder for each run, written in epoch order and read back."""
    base = scratch_path(t.spark, "logs")
    lines = t.runlog.select("run", "epoch", F.concat_ws(" ", "train_loss", "valid_loss").alias("value"))
    lines.repartition("run").sortWithinPartitions("run", "epoch").select("run", "value").write.partitionBy("run").text(base)
    read = text.read_run_logs(t.spark, base)
    return read.select("run", "epoch", r6("train_loss").alias("train_loss"), r6("valid_loss").alias("valid_loss"))


@query("log_cut_epochs", """
    select r.run, count(*)::bigint as epochs, round(min(valid_loss),6) as min_loss from runlog r where epoch<=20 group by r.run""")
def log_cut_epochs(t):
    """The first twenty epochs of every run: the cut is what the operator does."""
    return runs.cut_epochs(t.runlog, 20).groupBy("run").agg(
        F.count(F.lit(1)).alias("epochs"), r6(F.min("valid_loss")).alias("min_loss")
    )


@query("log_run_catalog", """
    with f as (select user_id as run, max(event_type='error') as pointer, max(event_type='click') as scov, max(event_type='view') as wcov,
        min(event_id)%2=0 as fcopy, max(event_id)%2=0 as rev, case max(event_id)%3 when 0 then 'gate' when 1 then 'res' end as feed,
        count(*)%3+1 as layers, count(*) as hidden from events group by user_id)
    select run, concat_ws('_','hie', case when pointer then 'pointer' end, case when scov then 'Scov' end, case when wcov then 'Wcov' end,
        case when wcov and fcopy then 'Fcopy' end, case when rev then 'rev' end, 'feed'||feed, layers, 1, 10, hidden) as run_name,
      'hie' as family, pointer, scov or wcov as coverage, wcov and fcopy as force_copy, rev as reverse, feed, layers::bigint as layers,
      1::bigint as word_layer, 10::bigint as top_k, hidden::bigint as hidden from f""")
def log_run_catalog(t):
    kind = lambda k: F.max(F.col("event_type") == k)
    flags = t.read("events").groupBy(F.col("user_id").alias("run")).agg(
        kind("error").alias("pointer"), kind("click").alias("sentence_coverage"), kind("view").alias("word_coverage"),
        (F.min("event_id") % 2 == 0).alias("force_copy"), (F.max("event_id") % 2 == 0).alias("reverse"),
        F.when(F.max("event_id") % 3 == 0, "gate").when(F.max("event_id") % 3 == 1, "res").alias("feed"),
        (F.count(F.lit(1)) % 3 + 1).alias("sentence_layer"), F.lit(1).alias("word_layer"), F.lit(10).alias("top_k"),
        F.count(F.lit(1)).alias("hidden"),
    )
    named = flags.select("run", runs.hierarchical_name().alias("run_name"))
    return runs.parse_run_name(named).drop("vocab_size")


@query("log_flat_catalog", """
    with f as (select user_id as run, max(event_type='error') as pointer, max(event_type='click') as cov, max(event_id)%2=0 as rev,
        count(*) as hidden from events group by user_id)
    select run, concat_ws('_','pgn', case when pointer then 'pointer' end, case when cov then 'cov' end, case when rev then 'rev' end,
        1, hidden, 4176) as run_name, 'pgn' as family, pointer, cov as coverage, rev as reverse, 1::bigint as layers,
      hidden::bigint as hidden, 4176::bigint as vocab_size from f""")
def log_flat_catalog(t):
    kind = lambda k: F.max(F.col("event_type") == k)
    flags = t.read("events").groupBy(F.col("user_id").alias("run")).agg(
        kind("error").alias("pointer"), kind("click").alias("coverage"), (F.max("event_id") % 2 == 0).alias("reverse"),
        F.lit(1).alias("layer"), F.count(F.lit(1)).alias("hidden"), F.lit(4176).alias("vocab_size"),
    )
    named = flags.select("run", runs.flat_name().alias("run_name"))
    return runs.parse_run_name(named).drop("force_copy", "feed", "word_layer", "top_k")


@query("log_best_epoch", """
    select run, arg_min(epoch, valid_loss*100000+epoch) as epoch, min(valid_loss) as valid_loss from runlog group by run""")
def log_best_epoch(t):
    return runs.best_epoch(t.runlog)


@query("log_checkpoint_plan", """
    with p as (select *, min(valid_loss) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as low,
        max(epoch) over (partition by run) as final from runlog),
    s as (select *, row_number() over (partition by run order by epoch desc) as rn from p where low is null or valid_loss<=low or epoch=final)
    select run, epoch, valid_loss, rn<=3 as kept from s""")
def log_checkpoint_plan(t):
    return runs.checkpoint_plan(t.runlog).select("run", "epoch", "valid_loss", "kept")


@query("log_epoch_means", """
    select run, epoch, count(*)::bigint as steps, round(avg(loss),6) as mean_loss from steplog group by all""")
def log_epoch_means(t):
    return runs.epoch_means(t.steplog).withColumn("mean_loss", r6("mean_loss"))


@query("log_resume_state", """
    with r as (select run, max(epoch)//2 as restored from runlog group by run)
    select run, r.restored as restored_epoch, count(*)::bigint as epochs_kept, min(valid_loss) as min_valid_loss
    from runlog join r using (run) where epoch<=r.restored group by all""")
def log_resume_state(t):
    restored = t.runlog.groupBy("run").agg(F.floor(F.max("epoch") / 2).alias("epoch"))
    return runs.resume_state(t.runlog, restored)


# -- streaming ---------------------------------------------------------------------------------

@query("stream_bleu", """
    select b.model, count(*)::bigint as n, round(100.0*sum(exact::int)/count(*),6)::double as exact_match, round(any_value(b.bleu),6) as bleu
    from bleu_g b join seg_tok s on s.model=b.model group by b.model""")
def stream_bleu(t):
    base = scratch_path(t.spark, "stream-bleu")
    t.preds.select("model", "idx", "hyp").write.parquet(f"{base}/in")
    schema = t.preds.select("model", "idx", "hyp").schema
    refs = t.segments.select("idx", "ref")
    streaming.stream_scores(t.spark, f"{base}/in", schema, refs, f"{base}/out", f"{base}/ck").awaitTermination()
    out = streaming.rolled_up(t.spark, f"{base}/out").drop("unmatched")
    return out.withColumns({"exact_match": r6("exact_match"), "bleu": r6("bleu")})


@query("stream_best_epoch", """
    select run, arg_min(epoch, valid_loss*100000+epoch) as epoch, min(valid_loss) as valid_loss from runlog group by run""")
def stream_best_epoch(t):
    base = scratch_path(t.spark, "stream-runs")
    log = t.runlog.select("run", "epoch", "valid_loss")
    log.write.parquet(f"{base}/in")
    streaming.stream_best_epoch(t.spark, f"{base}/in", log.schema, f"{base}/out", f"{base}/ck").awaitTermination()
    return streaming.latest_best_epoch(t.spark, f"{base}/out")
