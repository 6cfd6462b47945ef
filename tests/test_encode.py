"""Vocabularies, wrapping and batches."""

from pyspark.sql import functions as F

from corpuslab.config import CS_FLAGS, JAVA_FLAGS, PAD, CorpusSpec
from corpuslab.functions.text import lower_unless
from corpuslab.operators import encode, statistics, vocab
from corpuslab.operators.ranks import rank_within

SPEC = CorpusSpec()


def matrix(spark, *ms):
    return spark.createDataFrame(list(enumerate(ms)), "idx bigint, m array<array<string>>")


def test_wrap_and_unwrap(spark):
    df = matrix(spark, [["a", "b"], ["c", "d", "e", "f", "g"]])
    rows = df.select(encode.wrap_lines(F.col("m"), 4, 4, CS_FLAGS).alias("r"))
    assert [" ".join(r) for r in rows.first().r] == [
        "a b </cs> <pad>", "c d e </cs>", "<cl> f g </cs>", "<cs> </CS> </cs> <pad>"]
    assert rows.select(encode.output_lines(F.col("r"), SPEC)).first()[0] == ["ab", "cdefg"]
    masks = rows.select(F.explode("r").alias("x")).select(
        encode.word_mask(F.col("x")).alias("w"), encode.line_mask(F.col("x")).alias("l")).collect()
    assert masks[0].w == [0, 0, 0, 1] and [m.l for m in masks] == [0, 0, 0, 0]


def test_wrap_edges(spark):
    df = matrix(spark, [["a", "b", "c"], ["a", "b", "c", "d"], []], [["", "x"], [""]])
    got = [r[0] for r in df.orderBy("idx").select(encode.wrap_lines(F.col("m"), 4, 6, JAVA_FLAGS)).collect()]
    assert [" ".join(r) for r in got[0]] == [
        "a b c </java>", "a b c </java>", "<cl> d </java> <pad>", "<java> </JAVA> </java> <pad>",
        "<pad> <pad> <pad> <pad>", "<pad> <pad> <pad> <pad>"]
    assert got[1][0] == ["x", "</java>", PAD, PAD] and got[1][1][1] == "</JAVA>"


def test_round_trip_when_nothing_is_cut(spark):
    lines = [["▁a", "$$b", "▁c"] * 5, ["x"], ["▁y"] * 11, ["z"] * 12]
    df = matrix(spark, lines)
    rows = df.select(encode.wrap_lines(F.col("m"), 7, 40, CS_FLAGS).alias("r"))
    want = ["".join(x).replace("$$", "").replace("▁", " ").strip() for x in lines]
    assert rows.select(encode.output_lines(F.col("r"), SPEC)).first()[0] == want


def plain_output(matrix):
    """The same rules, token by token."""
    out = []
    for row in matrix:
        line, stop = [], False
        for tok in row:
            if tok in ("</cs>", "</java>", "</CS>", "</JAVA>"):
                stop = tok in ("</CS>", "</JAVA>")
                break
            if tok == "<cl>":
                line += out.pop() if out else []
            elif tok not in (PAD, "<cs>", "<java>", "<CS>", "<JAVA>"):
                line.append(tok)
        out.append(line)
        if stop:
            break
    return ["".join(x) for x in out if x]


def test_model_output_cases(spark):
    cases = [
        [["<cs>", "a", "</cs>", "b"], ["<cl>", "c"], ["<cs>", "</CS>", "</cs>"], ["d"]],
        [["a"], [PAD, PAD], ["<cl>", "b"]], [["<cl>", "a"], ["b", "<cl>", "c", "<cl>"]],
        [["a", "</java>"], ["</JAVA>", "b"], ["c"]], [[], []], [["<cs>"], ["<cl>"], ["x", PAD, "y"]],
    ]
    df = matrix(spark, *cases)
    got = {r.idx: r.o for r in df.select("idx", encode.output_lines(F.col("m"), SPEC, subword=False).alias("o")).collect()}
    assert got == {i: plain_output(c) for i, c in enumerate(cases)}


def test_flat_padding(spark):
    df = spark.createDataFrame([(["a", "b"],), (list("abcdef"),)], "t array<string>")
    plain = [r[0] for r in df.select(encode.flat_padded(F.col("t"), 4)).collect()]
    ended = [r[0] for r in df.select(encode.flat_padded(F.col("t"), 4, "</java>")).collect()]
    assert plain == [["a", "b", PAD, PAD], list("abcd")]
    assert ended == [["a", "b", "</java>", PAD], list("abcd")]


def toks(spark, rows):
    return spark.createDataFrame(rows, "idx bigint, side string, line_no int, pos int, token string")


def test_vocabulary_and_extended_ids(spark):
    t = toks(spark, [(0, "key1", 0, i, w) for i, w in enumerate("b b b a a c q".split())]
             + [(0, "key1", 1, 0, "z"), (0, "key1", 1, 1, "q"), (0, "key2", 0, 0, "q"), (0, "key2", 0, 1, "nowhere"),
                (1, "key1", 0, 0, "z"), (1, "key2", 0, 0, "q")])
    v = vocab.build_vocab(t.filter("token in ('a','b','c')"), ["<pad>", "<unk>"], 4)
    assert [(r.id, r.token) for r in v.orderBy("id").collect()] == [(0, "<pad>"), (1, "<unk>"), (2, "b"), (3, "a")]
    ext = vocab.extended_vocab(t.filter("side = 'key1'"), v, ["idx"], 4)
    assert {(r.idx, r.token): r.ext_id for r in ext.collect()} == {(0, "c"): 4, (0, "q"): 5, (0, "z"): 6, (1, "z"): 4}
    coded = vocab.extended_ids(t, v, ext, ["idx"])
    ids = {(r.idx, r.side, r.line_no, r.pos): r.id for r in coded.collect()}
    assert ids[0, "key2", 0, 0] == 5 and ids[0, "key2", 0, 1] == 1 and ids[1, "key2", 0, 0] == 1
    back = vocab.decode_ids(coded, v, ext, ["idx"]).collect()
    assert all(r.decoded == (r.token if r.id != 1 else "<unk>") for r in back)
    fed = coded.select(vocab.plain_id(F.col("id"), 4).alias("i")).distinct().collect()
    assert max(r.i for r in fed) < 4
    assert {r.token: r.id for r in vocab.token_ids(t, v).collect()}["q"] == 1


def test_duplicate_token_takes_lowest_id(spark):
    v = spark.createDataFrame([(0, "x"), (1, "<unk>"), (7, "x")], "id bigint, token string")
    assert vocab.token_ids(toks(spark, [(0, "k", 0, 0, "x")]), v).first().id == 0


def test_vocabulary_join_is_broadcast_by_size(spark):
    t = toks(spark, [(0, "k", 0, i, w) for i, w in enumerate("a b a".split())])
    v = vocab.build_vocab(t, ["<pad>", "<unk>"], 10)
    plan = vocab.token_ids(t, v)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_lower_keeps_specials(spark):
    df = spark.createDataFrame([("</CS>",), ("Foo",)], "t string")
    assert [r[0] for r in df.select(lower_unless(F.col("t"), SPEC.special_tokens())).collect()] == ["</CS>", "foo"]


def test_batches_are_a_seeded_shuffle(spark):
    df = spark.range(1000).withColumnRenamed("id", "idx")
    a = {r.idx: r["rank"] for r in encode.assign_batches(df, "idx", 40, 1).collect()}
    again = {r.idx: r["rank"] for r in encode.assign_batches(df.repartition(9), "idx", 40, 1).collect()}
    other = {r.idx: r["rank"] for r in encode.assign_batches(df, "idx", 40, 2).collect()}
    assert sorted(a.values()) == list(range(1, 1001)) and a == again and a != other
    assert encode.sample_batches(encode.assign_batches(df, "idx", 40, 1), 3).count() == 120


def test_two_phase_rank_with_a_hot_key(spark):
    df = spark.range(3000).select((F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    got = rank_within(df, ["k"], F.floor(F.col("v") / 100), [F.col("v")]).collect()
    hot = sorted((r.v, r["rank"]) for r in got if r.k == 0)
    assert [k for _, k in hot] == list(range(1, len(hot) + 1)) and len(hot) == 2001


def test_statistics(spark):
    df = matrix(spark, [["a"] * 4, [""], ["b"] * 30], [["c"] * 61])
    sizes = statistics.line_sizes(df, {"key1": "m"})
    row = statistics.tokens_per_snippet(sizes).first()
    assert (row.n, row.max, row["sum"], row.bin0, row.bin1) == (2, 61, 95, 1, 1)
    assert statistics.lines_per_snippet(sizes).first()["max"] == 2
    line = statistics.tokens_per_line(sizes).first()
    assert (line.n, line.bin0, line.bin4) == (3, 1, 2)
