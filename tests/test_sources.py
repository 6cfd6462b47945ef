"""Files in and out, streams, registered queries."""

import glob
import json
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpuslab.config import KEYWORDS
from corpuslab.operators.scores import corpus_bleu, exact_match
from corpuslab.operators.segments import seg_stats
from corpuslab.plans import all_queries
from corpuslab.plans.oracle import with_tables
from corpuslab.session import shared_dir
from corpuslab.sources import corpus, text
from corpuslab.streaming import scores as streaming


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    f = tmp_path / "big.txt"
    f.write_text("\n".join(f"  line {i} " for i in range(5000)) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = text.read_indexed_lines(spark, str(f))
        assert got.rdd.getNumPartitions() > 3
        assert {r.idx: r.line for r in got.collect()} == {i: f"line {i}" for i in range(5000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parts_of_a_folder_continue_the_numbers(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("idx"), F.concat(F.lit("t"), "id").alias("t"))
    text.write_lines(df.repartition(5), "t", ["idx"], str(tmp_path / "out"))
    got = {r.idx: r.line for r in text.read_indexed_lines(spark, str(tmp_path / "out")).collect()}
    assert got == {i: f"t{i}" for i in range(100)}


def test_pairs_and_alignment(spark, tmp_path):
    (tmp_path / "train.cs").write_text("a\nb\n")
    (tmp_path / "train.java").write_text("A\nB\nC\n")
    got = text.read_pairs(spark, str(tmp_path / "train.cs"), str(tmp_path / "train.java"), "train").collect()
    assert sorted((r.split, r.idx, r.key1, r.key2) for r in got) == [("train", 0, "a", "A"), ("train", 1, "b", "B")]
    one, two = (text.read_indexed_lines(spark, str(tmp_path / f"train.{x}")) for x in ("cs", "java"))
    row = text.alignment_report(one, two, ["idx"]).first()
    assert (row.left_only, row.right_only, row.both, row.aligned) == (0, 1, 2, False)
    with pytest.raises(ValueError):
        text.require_aligned(one, two, ["idx"])
    text.require_aligned(one, one, ["idx"])


def test_split_by_file_name(spark, tmp_path):
    for name in ("x.train.cs", "my_valid.txt", "other.txt"):
        (tmp_path / name).write_text("l\n")
    assert sorted(str(r.split) for r in text.read_by_split(spark, str(tmp_path)).collect()) == ["None", "train", "valid"]


def test_keywords_and_logs(spark, tmp_path):
    (tmp_path / "java.txt").write_text("int\n for \n\n")
    assert [r.word for r in text.read_keywords(spark, str(tmp_path / "java.txt"), "java").collect()] == ["int", "for"]
    run = tmp_path / "runs" / "hie_1_1_10_64"
    run.mkdir(parents=True)
    (run / "message.log").write_text("3.0 2.5\n2.0 2.25\n")
    got = [(r.run, r.epoch, r.train_loss, r.valid_loss) for r in text.read_run_logs(spark, str(tmp_path / "runs")).orderBy("epoch").collect()]
    assert got == [("hie_1_1_10_64", 1, 3.0, 2.5), ("hie_1_1_10_64", 2, 2.0, 2.25)]
    assert [len(KEYWORDS[k]) for k in ("c_sharp", "java", "python")] == [107, 50, 35]


def test_parts_of_golden_blocks(spark):
    """A block's parts cut at its marks, against one expression for all of it; the whole text is searched once."""
    rng = random.Random(2)
    parts = ["===", "====  ", "\n", "\n", "---", "-----", "a", " (b)", "==", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(40)) for _ in range(150)]
    texts += [f"==={e}\n{n}\n===\n{c}\n---\n{t}" * k for e in ("", " ") for n in ("", "x", "---") for c in ("", "y\n---", "\n") for t in ("", "(a)\n") for k in (1, 2)]
    pattern = re.compile(r"={3,}[ \t]*\n([^\n]*)\n={3,}[ \t]*\n(.*?)\n---+[ \t]*\n(.*?)(?=\n={3,}[ \t]*\n[^\n]*\n={3,}|\Z)", re.S)
    want = [(i, k, *[g.strip(" \t\n") for g in m.groups()]) for i, x in enumerate(texts) for k, m in enumerate(pattern.finditer(x))]
    blocks = text.golden_blocks(spark.createDataFrame(list(enumerate(texts)), "i bigint, value string"))
    assert sorted(tuple(r) for r in blocks.collect()) == sorted(want) and len(want) > 50
    assert str(blocks._jdf.queryExecution().optimizedPlan()).count("|\\z)") == 1


def test_golden_blocks(spark, tmp_path):
    (tmp_path / "c.txt").write_text("====\none\n====\n\nint a;\n\n---\n\n(program\n  (x))\n\n=====\ntwo words\n=====\n\nb\n\n---\n\n(program)\n")
    got = text.read_golden_files(spark, str(tmp_path / "c.txt")).orderBy("block_no").collect()
    assert [(r.name, r.code, r.tree) for r in got] == [("one", "int a;", "(program\n  (x))"), ("two words", "b", "(program)")]


def test_json_corpus_both_layouts(spark, tmp_path):
    rows = [{"idx": i, "cs": "a", "java": "b", "cs_t": [["a"]], "java_t": [["b"], []]} for i in range(3)]
    (tmp_path / "old.json").write_text(json.dumps(rows))
    old = corpus.read_json(spark, str(tmp_path / "old.json"), "cs", "java", array=True)
    corpus.write_json(old, str(tmp_path / "new"))
    new = corpus.read_json(spark, str(tmp_path / "new"), "cs", "java")
    assert sorted(map(str, old.collect())) == sorted(map(str, new.collect())) and new.count() == 3


def test_records_need_both_sides(spark, tmp_path):
    df = spark.createDataFrame([("train", 0, [["a"]], [["b"]]), ("train", 1, [["a"]], []), ("test", 2, [], [["b"]]), ("test", 3, [["c"]], [["d"]])],
                               "split string, idx bigint, cs_t array<array<string>>, java_t array<array<string>>")
    corpus.write_records(df, "cs_t", "java_t", str(tmp_path / "r"))
    assert sorted(r.idx for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [0, 3]


def test_append_shows_reruns(spark, tmp_path):
    p = spark.createDataFrame([("m", 1, "x"), ("m", 2, "y")], "model string, idx bigint, hyp string")
    corpus.append_predictions(p.withColumn("batch", F.lit(0)), str(tmp_path / "p"))
    corpus.append_predictions(p.filter("idx = 2").withColumn("batch", F.lit(1)), str(tmp_path / "p"))
    doubled = corpus.duplicate_predictions(spark.read.parquet(str(tmp_path / "p"))).collect()
    assert [(r.idx, r.copies) for r in doubled] == [(2, 2)]


def test_stream_equals_batch(spark, tmp_path):
    refs = spark.createDataFrame([(i, f"a b c d e{i}") for i in range(6)], "idx bigint, ref string")
    preds = spark.createDataFrame([("m", i, f"a b c d e{i % 4}") for i in range(6)], "model string, idx bigint, hyp string")
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    preds.filter("idx < 3").write.parquet(folder)
    streaming.stream_scores(spark, folder, preds.schema, refs, out, ck).awaitTermination()
    preds.filter("idx >= 3").write.mode("append").parquet(folder)
    streaming.stream_scores(spark, folder, preds.schema, refs, out, ck).awaitTermination()
    streaming.stream_scores(spark, folder, preds.schema, refs, out, ck).awaitTermination()
    got = streaming.rolled_up(spark, out).first()
    stats = seg_stats(preds.join(refs, "idx"))
    assert got.n == 6 and got.bleu == pytest.approx(corpus_bleu(stats, ["model"]).first().bleu)
    assert got.exact_match == pytest.approx(exact_match(stats, ["model"]).first().exact_match)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    import shutil

    refs = spark.createDataFrame([(i, "a b c d e") for i in range(4)], "idx bigint, ref string")
    preds = spark.createDataFrame([("m", i, "a b c d") for i in range(4)], "model string, idx bigint, hyp string")
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    preds.write.parquet(folder)
    streaming.stream_scores(spark, folder, preds.schema, refs, out, ck).awaitTermination()
    before = streaming.rolled_up(spark, out).collect()
    shutil.rmtree(f"{ck}/commits")  # as if the job had died before the commit
    streaming.stream_scores(spark, folder, preds.schema, refs, out, ck).awaitTermination()
    assert streaming.rolled_up(spark, out).collect() == before


SF = "/root/testdata/sf0.001"
QUICK = ["metric_bleu_corpus", "metric_smooth_m6", "metric_weighted_recall", "tok_words", "enc_wrap_lines", "vocab_build",
         "stat_corpus_summary", "trace_total_loss", "log_checkpoint_plan", "flow_use_def", "src_block_records"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "events", "embeddings", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(map(str, (tuple(r) for r in df.select(*names).collect())))
    assert rows == sorted(map(str, want.fetchall()))


def test_flagship_and_registry(spark):
    assert entry.entry(spark).columns == ["model", "bleu", "exact_match", "code_bleu"]
    assert set(all_queries()) <= set(entry.queries())
    unchecked = set(all_queries()) - set(entry.oracle_sql())
    assert unchecked == {"bpe_train_merges"}
    assert with_tables("select 1") == "select 1"


def test_parts_go_by_number(spark, tmp_path):
    from corpuslab.sources.text import read_indexed_lines

    for number in (99999, 100000, 100001, 2):
        (tmp_path / f"part-{number:05d}-x.txt").write_text(f"line {number}\n")
    got = [r.line for r in read_indexed_lines(spark, str(tmp_path)).orderBy("idx").collect()]
    assert got == ["line 2", "line 99999", "line 100000", "line 100001"]


@pytest.mark.parametrize("text", ["a\rb", "a\nb"])
def test_line_breaks_are_rejected(spark, tmp_path, text):
    from corpuslab.sources.text import write_lines

    df = spark.createDataFrame([(0, "fine"), (1, text)], "idx bigint, line string")
    with pytest.raises(Exception, match="line break"):
        write_lines(df, "line", ["idx"], str(tmp_path / "out"))


@pytest.mark.parametrize("size, indent", [(64, None), (64, 2), (1 << 20, None)])
def test_array_files_are_read_by_many_tasks(spark, tmp_path, size, indent):
    rng = random.Random(size)
    chars = ['"', "\\", "{", "}", "[", "]", ",", "a", " ", "\n", "é", '\\"', "}{", '"}']
    made = [{"idx": i, "cs": "".join(rng.choice(chars) for _ in range(rng.randint(0, 30))), "java": None if i % 9 == 0 else f"{{{i}}}",
             "cs_t": [["}", '"'], []], "java_t": []} for i in range(60)]
    os.makedirs(tmp_path / "in")
    for n, part in enumerate((made[:40], made[40:], [])):
        (tmp_path / "in" / f"p{n}.json").write_text(json.dumps(part, ensure_ascii=bool(n), indent=indent))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        if size == 64:
            assert spark.read.option("lineSep", "}").text(str(tmp_path / "in")).rdd.getNumPartitions() > 20
        rows = corpus.read_json(spark, str(tmp_path / "in"), "cs", "java", array=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
    assert sorted((r.asDict() for r in rows), key=lambda r: r["idx"]) == made


def test_objects_of_array_files_are_not_dealt(spark, tmp_path):
    made = [{"idx": i, "cs": "}" * (i % 5) + '{"', "java": "\\"} for i in range(500)]
    (tmp_path / "one.json").write_text(json.dumps(made))
    back = corpus.read_array(spark, str(tmp_path), "idx bigint, cs string, java string")
    assert sorted((r.asDict() for r in back.collect()), key=lambda r: r["idx"]) == made
    plan = str(corpus.read_array(spark, str(tmp_path), "idx bigint")._jdf.queryExecution().executedPlan())
    assert plan.count("Exchange hashpartitioning") == 1  # only what goes on over the bounds of ranges meets others


def test_no_task_writes_a_whole_split(spark, tmp_path):
    docs = [(i, f'a "{i}", th\\e {{ou}}', "en", "s") for i in range(0, 400) if i % 10 < 8]  # one split
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    pattern = f"{shared_dir(spark).removeprefix('file:')}/**/json-array-*"
    known = set(glob.glob(pattern, recursive=True))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = all_queries()["src_json_array"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    [made] = set(glob.glob(pattern, recursive=True)) - known
    parts = sorted(glob.glob(f"{made}/split=train/part-*"))
    assert len(parts) > 1
    text = "".join(open(p).read() for p in parts)  # in order of their names they are one array
    assert [o["idx"] for o in json.loads(text)] == [d[0] for d in docs]
    assert sorted((r.idx, r.cs) for r in got) == [(d[0], d[1].replace(",", '}"{\\')) for d in docs]
