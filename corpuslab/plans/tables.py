"""Derived input tables, each a plan over the given tables.

The given tables hold no code, translations or traces, so these plans make some from them: a
parallel corpus from documents, five rewriting "models" from conversations, decode traces and
run logs from events. All rows and whole texts are used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.config import CorpusSpec
from corpuslab.functions.arrays import let, positions
from corpuslab.functions.text import snippet_lines, space_tokens, token_matrix, word_tokens
from corpuslab.operators.ranks import rank_within
from corpuslab.session import cut_lineage

SPEC = CorpusSpec()
MODELS = ["drop5", "drop11", "drop97", "sub9", "dup13"]
#: Bytes of the files of conversations to a task.
PIECE = 1 << 18
#: Bytes of the files of documents to a task that makes trees of them.
TREE_PIECE = 1 << 20
SIDE_WORDS = ["the", "of", "and", "in", "le", "der", "que"]

RULES = [
    ("toy", "doc", "sequence"), ("toy", "stmt", "assignment"), ("toy", "args", "rhs"),
    ("toy", "cap", "leaf"), ("toy", "word", "leaf"), ("toy", "num", "literal"),
    ("toy", "stop", "punctuation"),
]


def rewritten_words(words: Column, idx: Column, model: str) -> Column:
    """What the model of that name makes of a text, as words."""
    kept = {"drop5": 5, "drop11": 11, "drop97": 97}
    if model in kept:
        return F.filter(words, lambda w, i: (i * 7 + idx) % kept[model] != 0)
    if model == "sub9":
        return F.transform(words, lambda w, i: F.when(i % 9 == 0, F.concat(F.lit("x"), w)).otherwise(w))
    return F.flatten(F.transform(words, lambda w, i: F.array_repeat(w, F.when(i % 13 == 0, 2).otherwise(1))))


def rewrite(words: Column, idx: Column, model: str) -> Column:
    return F.array_join(rewritten_words(words, idx, model), " ")


class Tables:
    """Lazy derived tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows over all cores where the scan alone would give fewer tasks than there are.

        Texts are worked on row by row, so a small file of one row group would keep one core
        busy. A large table has enough splits and is left as it is.
        """
        cores = self.spark.sparkContext.defaultParallelism
        tasks = df.rdd.getNumPartitions()
        return df.repartition(cores) if tasks < cores else df

    def dealt(self, name: str, df: DataFrame, key: str, piece: int | None = None) -> DataFrame:
        """Rows made of one table in tasks by `key`, one for each `piece` (or `PIECE`) bytes of its files and for each core at least.

        A scan gives as many tasks as there are cores however large the files are, and a file of one row group
        only one of them; what is made of a text is many times the text. Texts dealt by their key are also where
        every later window, grouping and join by that key needs what is made of them, so only texts are shuffled.
        """
        held = int(str(self.read(name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return df.repartition(max(self.spark.sparkContext.defaultParallelism, -(-held // (piece or PIECE))), key)

    @cached_property
    def documents(self) -> DataFrame:
        return self.spread(self.read("documents").select("doc_id", "text", "lang", "source"))

    @cached_property
    def segments(self) -> DataFrame:
        """Reference texts: every turn of every conversation."""
        texts = self.read("conversations").select(
            (F.shiftleft("conv_id", 20) + F.col("turn")).alias("idx"), "role", "conv_id", "text"
        )
        return self.dealt("conversations", texts, "idx").select(
            "idx", "role", "conv_id", F.array_join(space_tokens(F.col("text")), " ").alias("ref")
        )

    @cached_property
    def preds(self) -> DataFrame:
        """model, idx, ref, hyp: each text as each of five models rewrites it, made row by row."""
        made = let(
            F.split("ref", " "),
            lambda w: F.array(*[
                F.struct(F.lit(m).alias("model"), rewrite(w, F.col("idx"), m).alias("hyp"))
                for m in MODELS
            ]),
        )
        return self.segments.select("idx", "ref", F.inline(made)).select("model", "idx", "ref", "hyp")

    @cached_property
    def multiref(self) -> DataFrame:
        """Three references per prediction of one model."""
        words = F.split("ref", " ")
        half = F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))
        return self.segments.select(
            "idx",
            F.array(
                F.col("ref"),
                let(words, lambda w: rewrite(w, F.col("idx"), "sub9")),
                F.array_join(F.slice(words, F.lit(1), half), " "),
            ).alias("refs"),
            let(words, lambda w: rewrite(w, F.col("idx"), "drop11")).alias("hyp"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Parallel corpus: the second side is a respelling of the first."""
        digit = F.col("doc_id") % 10
        return self.documents.select(
            F.when(digit < 8, "train").when(digit == 8, "valid").otherwise("test").alias("split"),
            F.col("doc_id").alias("idx"),
            F.col("text").alias("key1"),
            F.replace(
                F.replace("text", F.lit(" th"), F.lit(" d")), F.lit("ou"), F.lit("u")
            ).alias("key2"),
        )

    @cached_property
    def matrices(self) -> DataFrame:
        """Token matrix per side."""
        return self.pairs.select(
            "split", "idx", token_matrix(F.col("key1")).alias("tok1"),
            token_matrix(F.col("key2")).alias("tok2"),
        )

    @cached_property
    def toks(self) -> DataFrame:
        """split, idx, side, line_no, pos, token"""
        sides = F.array(*[
            F.struct(F.lit(k).alias("side"), snippet_lines(F.col(k)).alias("lines"))
            for k in ("key1", "key2")
        ])
        return (
            self.pairs.select("split", "idx", F.inline(sides))
            .select("split", "idx", "side", F.posexplode("lines").alias("line_no", "line"))
            .select("split", "idx", "side", "line_no",
                    F.posexplode(word_tokens(F.col("line"))).alias("pos", "token"))
        )

    @cached_property
    def vocab(self) -> DataFrame:
        """The training tokens' vocabulary, written once."""
        from corpuslab.operators.vocab import build_vocab

        train = self.toks.filter(F.col("split") == "train")
        return cut_lineage(build_vocab(train, SPEC.special_tokens(), SPEC.vocab_size))

    @cached_property
    def user_events(self) -> DataFrame:
        """Events numbered per user; days are the pieces of a long history."""
        return rank_within(
            self.read("events"), ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], "rn"
        )

    @cached_property
    def attn(self) -> DataFrame:
        """Raw attention per example, decode step and source position."""
        src = self.user_events.select(
            F.col("user_id").alias("ex"), "event_id", (F.col("rn") - 1).alias("src"),
            (F.col("event_type") == "error").cast("int").alias("mask"),
        )
        ex, step = F.col("ex"), F.col("step")
        return src.withColumn(
            "step", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)]))
        ).select(
            "ex", "step", "src", F.floor(F.col("src") / 5).alias("line_no"),
            (((F.col("event_id") * (step + 3)) % 17) / 4.0).alias("score"), "mask",
            (F.col("event_id") % 50).alias("ext_id"), (((ex * 3 + step) % 10) / 10.0).alias("p_gen"),
            ((ex + step) % 50).alias("y_true"),
            F.when((ex + step) % 6 == 0, 1).otherwise(0).alias("y_mask"),
        )

    @cached_property
    def weights(self) -> DataFrame:
        """Attention weights; written once, since penalties and losses read them many times."""
        from corpuslab.operators.trace import masked_softmax

        return cut_lineage(masked_softmax(cut_lineage(self.attn)))

    @cached_property
    def covered(self) -> DataFrame:
        from corpuslab.operators.trace import coverage

        return cut_lineage(coverage(self.weights))

    @cached_property
    def dist(self) -> DataFrame:
        """Vocabulary distribution per example and step."""
        ids = F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint"))
        weight = lambda i: 1 + (i * (F.col("step") + 1) + F.col("ex")) % 7
        steps = self.read("events").select(F.col("user_id").alias("ex")).distinct().withColumn(
            "step", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)]))
        )
        total = F.aggregate(F.transform(ids, weight), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return steps.withColumn("total", total).select(
            "ex", "step", "total", F.explode(ids).alias("id")
        ).select("ex", "step", "id", (weight(F.col("id")) / F.col("total")).alias("p"))

    @cached_property
    def runlog(self) -> DataFrame:
        """Loss log: a run per user, an epoch per event."""
        return self.user_events.select(
            F.col("user_id").alias("run"), F.col("rn").alias("epoch"),
            F.col("value").alias("train_loss"),
            (F.floor("value") % 50).cast("double").alias("valid_loss"),
        )

    @cached_property
    def steplog(self) -> DataFrame:
        return self.user_events.select(
            F.col("user_id").alias("run"), F.floor((F.col("rn") - 1) / 10).alias("epoch"),
            ((F.col("rn") - 1) % 10).alias("step"), F.col("value").alias("loss"),
        )

    @cached_property
    def side_texts(self) -> DataFrame:
        """ex, side, words: the reference as side `ref`, each prediction as its model's side."""
        made = let(
            F.split("ref", " "),
            lambda w: F.array(
                F.struct(F.lit("ref").alias("side"), w.alias("words")),
                *[
                    F.struct(
                        F.lit(m).alias("side"),
                        rewritten_words(w, F.col("idx"), m).alias("words"),
                    )
                    for m in MODELS
                ],
            ),
        )
        return self.segments.select(F.col("idx").alias("ex"), F.inline(made))

    @cached_property
    def sidewords(self) -> DataFrame:
        return self.side_texts.select("ex", "side", F.posexplode("words").alias("pos", "w")).withColumn(
            "pos", F.col("pos").cast("bigint")
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """Four-level trees: doc, statements of six words, arguments from the fourth on, leaves."""

        def node(node_id, parent, order, kind):
            return F.struct(
                node_id.cast("bigint").alias("node_id"), parent.cast("bigint").alias("parent_id"),
                order.cast("bigint").alias("ord"), F.lit(kind).alias("type"),
            )

        size, none, zero = F.size("words"), F.lit(None), F.lit(0)
        stmt_no = positions(F.ceil(size / 6).cast("int"))
        stmts = F.transform(stmt_no, lambda s: node(s * 100 + 1, zero, s, "stmt"))
        args = F.transform(
            F.filter(stmt_no, lambda s: s * 6 + 3 < size),
            lambda s: node(s * 100 + 2, s * 100 + 1, F.lit(3), "args"),
        )
        root = F.array(node(zero, none, zero, "doc"))
        inner = self.side_texts.select("ex", "side", F.inline(F.concat(root, stmts, args))).select(
            "*", F.lit(True).alias("is_named"), F.lit(None).cast("string").alias("text")
        )
        w, stmt, k = F.col("w"), F.floor(F.col("pos") / 6), F.col("pos") % 6
        kind = (
            F.when(w.rlike("^[0-9]+$"), "num").when(w.rlike("[.,;]"), "stop")
            .when(w.rlike(r"^\p{Lu}"), "cap").otherwise("word")
        )
        leaves = self.sidewords.select(
            "ex", "side", (stmt * 100 + 10 + k).alias("node_id"),
            (stmt * 100 + F.when(k >= 3, 2).otherwise(1)).alias("parent_id"), k.alias("ord"),
            kind.alias("type"), w.alias("text"),
        ).withColumn("is_named", F.col("type") != "stop")
        return inner.unionByName(leaves)

    @cached_property
    def occ(self) -> DataFrame:
        """Variable occurrences: six words a statement, the first one is defined."""
        return self.sidewords.select(
            "ex", "side", F.floor(F.col("pos") / 6).alias("stmt"), "pos",
            F.lower(F.substring("w", 1, 2)).alias("name"),
            F.when(F.col("pos") % 6 == 0, "lhs").otherwise("rhs").alias("role"),
            (F.col("pos") % 6 == 0).alias("is_def"),
        )

    @cached_property
    def blocks(self) -> DataFrame:
        """Block graph with forward, skipping and back edges; two statements a block."""
        last = F.floor((F.size("words") - 1) / 12)

        def edge(cond: Column, gap: int) -> Column:
            a = F.col("block")
            return F.when(cond & (a + gap <= last) & (a + gap >= 0), a + gap)

        a = F.col("block")
        succ = F.filter(
            F.array(edge(F.lit(True), 1), edge(a % 3 == 0, 2), edge(a % 4 == 3, -1)),
            lambda x: x.isNotNull(),
        )
        return (
            self.side_texts.filter(F.size("words") > 0)
            .select("ex", "side", "words", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
            .select("ex", "side", "block", F.explode(succ).alias("succ"))
        )

    @cached_property
    def flows(self) -> DataFrame:
        """Data-flow edges: uses and assignments over `occ`."""
        from corpuslab.operators.flow import assignments, use_def

        return use_def(self.occ).filter(F.col("role") == "rhs").drop("role").unionByName(
            assignments(self.occ)
        )

    @cached_property
    def code_nodes(self) -> DataFrame:
        """Syntax trees with field labels in seven languages."""
        from corpuslab.plans.code_trees import code_nodes

        return code_nodes(self.sidewords)

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.createDataFrame(RULES, "lang string, node_type string, role string")
