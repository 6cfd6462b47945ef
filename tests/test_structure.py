"""Trees and data flow."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import flow, structure, trees
from corpuslab.plans import code_trees, metric_queries, tables

OCC = "ex bigint, side string, stmt bigint, pos bigint, name string, role string, block bigint"


def nodes(spark, rows):
    return spark.createDataFrame(
        [(0, s, *r) for s, rs in rows.items() for r in rs],
        "ex bigint, side string, node_id bigint, parent_id bigint, ord bigint, type string, is_named boolean, text string")


TREE = [
    (0, None, 0, "program", True, None), (1, 0, 0, "stmt", True, None), (2, 0, 1, "stmt", True, None),
    (3, 1, 0, "name", True, "x"), (4, 1, 1, "=", False, "="), (5, 1, 2, "string", True, '"a b"'),
    (6, 5, 0, "inner", True, "a b"), (7, 2, 0, "comment", True, "// c"), (8, 2, 1, "name", True, "y"),
]


def test_subtrees_and_depth(spark):
    got = {r.node_id: (r.depth, r.sexp) for r in trees.subtrees(nodes(spark, {"ref": TREE})).collect()}
    assert got == {
        0: (1, "(program (stmt (name) (string (inner))) (stmt (comment) (name)))"),
        1: (2, "(stmt (name) (string (inner)))"), 2: (2, "(stmt (comment) (name))"), 5: (3, "(string (inner))"),
    }


def test_digests_are_equal_where_subtrees_are(spark):
    df = nodes(spark, {"ref": TREE, "m": TREE})
    a = {(r.side, r.node_id): r.sexp for r in trees.subtrees(df).collect()}
    b = {(r.side, r.node_id): r.sexp for r in trees.subtrees(df, digests=True).collect()}
    assert a.keys() == b.keys() and all((a[x] == a[y]) == (b[x] == b[y]) for x in a for y in a)


def test_what_nodes_hold_is_not_dealt_once_a_level(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(trees, "cut_lineage", lambda df, real=trees.cut_lineage: seen.append(df.columns) or real(df))
    rows = [(0, "ref", i, i - 1 if i else None, 0, "n", True, None) for i in range(6)]
    # a node that comes twice stands as often as its parent, at each of its copies
    rows += [(1, "ref", 0, None, 0, "r", True, None)] * 2 + [(1, "ref", 1, 0, 0, "a", True, None)] * 2 + [(1, "ref", 2, 1, 0, "b", True, None)]
    df = spark.createDataFrame(rows, "ex bigint, side string, node_id bigint, parent_id bigint, ord bigint, type string, is_named boolean, text string")
    got = sorted((r.ex, r.node_id, r.depth, r.sexp) for r in trees.subtrees(df).collect())
    assert [r[2] for r in got if r[0] == 0] == [1, 2, 3, 4, 5] and got[0][3] == "(n (n (n (n (n (n))))))"
    assert [r[1:] for r in got if r[0] == 1] == [(0, 1, "(r" + " (a (b))" * 4 + ")")] * 2 + [(1, 2, "(a (b))")] * 4
    assert seen and not any("leaf_kids" in columns or "sexp" in columns for columns in seen)


def test_childless_root_and_anonymous_children(spark):
    df = nodes(spark, {"a": [(0, None, 0, "program", True, None)],
                       "b": [(0, None, 0, "program", True, None), (1, 0, 0, ";", False, ";")]})
    assert {r.side: r.sexp for r in trees.subtrees(df).collect()} == {"a": "(program)", "b": "(program)"}


def test_deep_tree(spark):
    chain = [(i, i - 1 if i else None, 0, f"n{i}", True, None) for i in range(11)]
    got = {r.node_id: r.sexp for r in trees.subtrees(nodes(spark, {"ref": chain})).collect()}
    assert got[9] == "(n9 (n10))" and got[0].count("(") == 11 and len(got) == 10


def test_leaves(spark):
    leaves = trees.leaf_tokens(nodes(spark, {"ref": TREE}))
    assert [r.text for r in leaves.orderBy("tok").collect()] == ["x", "=", '"a b"', "y"]
    assert [r.text for r in trees.variable_leaves(leaves).orderBy("tok").collect()] == ["x", '"a b"', "y"]


def test_span_texts(spark):
    lines = spark.createDataFrame([(0, 0, "hello"), (0, 1, "wide"), (0, 2, "world")], "doc_id bigint, line_no int, line string")
    spans = spark.createDataFrame([(0, 1, 0, 1, 0, 3), (0, 2, 0, 3, 2, 2)],
                                  "doc_id bigint, span_id bigint, start_row int, start_col int, end_row int, end_col int")
    assert {r.span_id: r.text for r in trees.span_texts(spans, lines).collect()} == {1: "el", 2: "lowidewo"}


def test_subtree_membership_is_not_clipped(spark):
    ref = spark.createDataFrame([(0, "ref", s) for s in "sst"] + [(0, "m", "s")], "ex bigint, side string, sexp string")
    pairs = spark.createDataFrame([("m", 0)], "model string, idx bigint")
    row = trees.syntax_match(pairs, ref).first()
    assert (row.hit, row.total) == (2, 3)


def test_data_flow_is_clipped(spark):
    bags = spark.createDataFrame([(0, "ref", "A", 2), (0, "ref", "B", 1), (0, "m", "A", 1), (0, "m", "B", 2)],
                                 "ex bigint, side string, edge string, cnt bigint")
    pairs = spark.createDataFrame([("m", 0), ("m", 1)], "model string, idx bigint")
    got = {r.idx: (r.hit, r.total) for r in flow.dataflow_match(pairs, bags).collect()}
    assert got == {0: (2, 3), 1: (0, 0)}
    total = trees.ratio(flow.dataflow_match(pairs.filter("idx = 1"), bags), ["model"], "f", F.lit(0.0)).first().f
    assert total == 0.0


EDGES = "ex bigint, side string, name string, pos bigint, relation string, parent_names array<string>, parent_pos array<bigint>"


def edges(spark, rows):
    return spark.createDataFrame([(0, "ref", *r) for r in rows], EDGES)


def test_name_normalisation(spark):
    df = edges(spark, [("x", 1, "r", ["y"], [0]), ("y", 2, "r", [], []), ("x", 3, "r", ["y", "z"], [0, 9])])
    got = [(r.name, r.parent_names) for r in flow.normalize_names(df).orderBy("pos").collect()]
    assert got == [("var_1", ["var_0"]), ("var_0", []), ("var_1", ["var_0", "var_2"])]
    inside = [(r.name, r.parent_names) for r in flow.normalize_within_edge(df).orderBy("pos").collect()]
    assert inside == [("var_1", ["var_0"]), ("var_0", []), ("var_2", ["var_0", "var_1"])]


def test_isolated_and_merged(spark):
    df = edges(spark, [("a", 1, "r", [], []), ("b", 2, "r", [], []), ("c", 3, "r", ["b"], [2]), ("c", 3, "r", ["a", "b"], [0, 2])])
    kept = flow.drop_isolated(df)
    assert sorted(r.pos for r in kept.collect()) == [2, 3, 3]
    merged = {r.pos: (r.parent_names, r.parent_pos) for r in flow.merge_nodes(kept).collect()}
    assert merged == {2: ([], []), 3: (["a", "b"], [0, 2])}
    both = {r.pos: (r.parent_names, r.parent_pos) for r in flow.connected_nodes(df).collect()}
    assert both == merged


def occ(spark, rows):
    return spark.createDataFrame([(0, "ref", s, p, n, role, b) for s, p, n, role, b in rows], OCC)


def test_use_def_order(spark):
    # a = b ; a = a : the second use of a links to the first statement, not to its own target
    df = occ(spark, [(0, 0, "a", "lhs", 0), (0, 1, "b", "rhs", 0), (1, 2, "a", "lhs", 0), (1, 3, "a", "rhs", 0), (2, 4, "b", "rhs", 0)])
    got = {r.pos: r.parent_pos for r in flow.use_def(df).filter("role = 'rhs'").collect()}
    assert got == {1: [], 3: [0], 4: [1]}


def test_statement_edges(spark):
    df = occ(spark, [(0, 0, "a", "lhs", 0), (0, 1, "b", "rhs", 0), (0, 2, "c", "rhs", 0), (1, 3, "d", "lhs", 0)])
    assert sorted((r.pos, tuple(r.parent_names)) for r in flow.declarations(df).collect()) == [(0, ("b",)), (0, ("c",)), (3, ())]
    assert sorted(tuple(r.parent_names) for r in flow.assignments(df).collect()) == [("b",), ("c",)]
    assert flow.assignments_grouped(df).first().parent_pos == [1, 2]
    inc = flow.increments(df.filter("stmt = 0")).collect()
    assert {tuple(r.parent_pos) for r in inc} == {(0, 1, 2)} and len(inc) == 3


def test_tuple_assignment_pairs_by_place(spark):
    rows = [(0, 0, "a", "lhs", 0), (0, 1, "b", "lhs", 0), (0, 2, "x", "rhs", 0), (0, 3, "y", "rhs", 0)]
    df = occ(spark, rows).withColumn("item", F.col("pos") % 2)
    got = {r.name: r.parent_names for r in flow.assignments_grouped(df, "item").collect()}
    assert got == {"a": ["x"], "b": ["y"]}


def test_statement_edges_are_dealt_once_and_not_broadcast(spark, capsys):
    # words unrolled from few rows look small to the planner: a join would send them through the driver
    texts = spark.range(3).select(F.col("id").alias("ex"), F.lit("ref").alias("side"), F.explode(F.expr("sequence(0L, 11L)")).alias("pos"))
    place = F.col("pos") % 6
    df = texts.select("ex", "side", F.floor(F.col("pos") / 6).alias("stmt"), "pos", F.concat(F.lit("w"), place).alias("name"),
                      F.when(place < 2, "lhs").otherwise("rhs").alias("role"), (place % 2).alias("item"))
    for edges, rows in ((flow.declarations(df), 48), (flow.assignments(df), 48), (flow.assignments_grouped(df), 12),
                        (flow.assignments_grouped(df, "item"), 12), (flow.increments(df), 36)):
        assert edges.count() == rows
        edges.explain()
        plan = capsys.readouterr().out
        assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange") <= 1


def test_statement_edges_of_repeated_and_null_keys(spark):
    rows = [(0, 0, 0, "a", "lhs"), (0, 0, 0, "a", "lhs"), (0, 0, 1, "b", "rhs"), (0, 0, 1, "b", "rhs"), (None, 0, 0, "c", "lhs"), (None, 0, 1, "d", "rhs")]
    df = spark.createDataFrame([(ex, "ref", s, p, n, r) for ex, s, p, n, r in rows], "ex bigint, side string, stmt bigint, pos bigint, name string, role string")
    got = lambda edges: sorted((str(r.ex), r.name, tuple(r.parent_pos)) for r in edges.collect())
    assert got(flow.assignments(df)) == [("0", "a", (1,))] * 4
    assert got(flow.declarations(df)) == [("0", "a", (1,))] * 4 + [("None", "c", ())]
    assert got(flow.assignments_grouped(df)) == [("0", "a", (1, 1))] * 2
    assert got(flow.increments(df)) == [("0", "a", (0, 0, 1, 1))] * 2 + [("0", "b", (0, 0, 1, 1))] * 2


def branch(spark, lang, has_else):
    """x=1; if(c){x=2;} [else{x=3;}] y=x; in blocks 0, 1, [2], 3"""
    bodies = [1, 2] if has_else else [1]
    rows = [(0, 1, "x", "lhs", 0), (1, 2, "x", "lhs", 1)] + ([(2, 3, "x", "lhs", 2)] if has_else else [])
    rows += [(3, 9, "y", "lhs", 3), (3, 10, "x", "rhs", 3)]
    graph = spark.range(1).select(F.lit(0).cast("bigint").alias("ex"), F.lit("ref").alias("side"), F.inline(flow.branch_edges(
        F.lit(has_else), F.lit(0), F.array(*[F.lit(b) for b in bodies]), F.lit(3), F.lit(0), F.lit(lang))))
    return flow.reaching_definitions(occ(spark, rows), graph).first().parent_pos


@pytest.mark.parametrize("lang, has_else, want", [
    ("java", False, [1, 2]), ("python", False, [1, 2]), ("javascript", False, [1, 2]),
    ("python", True, [2, 3]), ("ruby", True, [2, 3]), ("java", True, [1, 2, 3]), ("go", True, [1, 2, 3]),
    ("php", True, [1, 2, 3]), ("c_sharp", True, [1, 2, 3]), ("javascript", True, [1, 3]),
])
def test_branch_merge_by_language(spark, lang, has_else, want):
    assert branch(spark, lang, has_else) == want


def test_loop_reaches_back(spark):
    # x=0; while(c){ y=x; x=x+1; } z=x
    rows = [(0, 0, "x", "lhs", 0), (1, 1, "y", "lhs", 1), (1, 2, "x", "rhs", 1), (2, 3, "x", "lhs", 1), (2, 4, "x", "rhs", 1),
            (3, 5, "z", "lhs", 2), (3, 6, "x", "rhs", 2)]
    graph = spark.createDataFrame([(0, "ref", 0, 1), (0, "ref", 1, 1), (0, "ref", 1, 2)], "ex bigint, side string, block bigint, succ bigint")
    got = {r.pos: r.parent_pos for r in flow.merge_edges(flow.reaching_definitions(occ(spark, rows), graph)).collect()}
    assert got == {2: [0, 3], 4: [0, 3], 6: [3]}


def graph_of(spark, edges):
    return spark.createDataFrame([(0, "ref", a, b) for a, b in edges], "ex bigint, side string, block bigint, succ bigint")


def reached(spark, rows, edges):
    return {r.pos: r.parent_pos for r in flow.reaching_definitions(occ(spark, rows), graph_of(spark, edges)).collect()}


def test_first_sight_defines_a_name_across_blocks(spark):
    rows = [(0, 0, "x", "rhs", 0), (1, 1, "x", "rhs", 1), (2, 2, "x", "rhs", 1)]
    assert reached(spark, rows, [(0, 1)]) == {0: [], 1: [0], 2: [0]}
    # seen in two branches only: each is a first sight, both reach the end
    rows = [(0, 0, "x", "rhs", 1), (1, 1, "x", "rhs", 2), (2, 2, "x", "rhs", 3)]
    assert reached(spark, rows, [(0, 1), (0, 2), (1, 3), (2, 3)]) == {0: [], 1: [], 2: [0, 1]}
    # over a loop the later definition joins the first sight
    rows = [(0, 0, "x", "rhs", 0), (1, 1, "x", "lhs", 1), (2, 2, "x", "rhs", 0)]
    assert reached(spark, rows, [(0, 1), (1, 0)]) == {0: [1], 2: [0, 1]}


def test_a_long_chain_of_blocks_takes_one_job(spark):
    n = 20_000
    rows = [(0, 0, "x", "lhs", 0), (n - 1, 1, "x", "rhs", n - 1), (n - 1, 2, "y", "rhs", n - 1)]
    edges = spark.range(n - 1).selectExpr("0L as ex", "'ref' as side", "id as block", "id + 1 as succ")
    got = {r.pos: r.parent_pos for r in flow.reaching_definitions(occ(spark, rows), edges).collect()}
    assert got == {1: [0], 2: []}


def test_a_pair_without_a_tree_stays(spark):
    tree = spark.createDataFrame([(0, "ref", "s"), (0, "m", "s"), (1, "m", "s")], "ex bigint, side string, sexp string")
    pairs = spark.createDataFrame([("m", 0), ("m", 1)], "model string, idx bigint")
    got = {r.idx: (r.total, r.hit) for r in trees.syntax_match(pairs, tree).collect()}
    assert got == {0: (1, 1), 1: (0, 0)}


def test_rule_table(spark):
    rules = flow.rule_table(spark)
    assert rules.select("lang").distinct().count() == 7
    assert flow.rule_table(spark, fill_gaps=True).filter("lang = 'go' and role = 'increment'").count() == 2
    df = nodes(spark, {"ref": [(0, None, 0, "if_statement", True, None), (1, 0, 0, "other", True, None)]}).withColumn("lang", F.lit("java"))
    assert {r.type: r.role for r in flow.classify_nodes(df, rules).collect()} == {"if_statement": "if", "other": None}


def test_texts_are_dealt_into_tasks_by_their_size(spark, tmp_path, monkeypatch):
    from corpuslab.plans import tables

    monkeypatch.setattr(tables, "PIECE", 1024, raising=False)
    texts = spark.range(400).select(F.col("id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    texts.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    held = tables.Tables(spark, str(tmp_path)).segments
    sizes = [r["count"] for r in held.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 400 and len(sizes) > 16 and max(sizes) <= 400 / len(sizes) + len(sizes)


def test_trees_are_kept_compressed_and_never_broadcast(spark, monkeypatch, capsys):
    words = [(ex, "ref", p, f"{'abcde'[(ex + p) % 5]}{p % 3}") for ex in range(3) for p in range(40)]
    df = code_trees.code_nodes(spark.createDataFrame(words, "ex bigint, side string, pos bigint, w string"))
    seen, frame = [], type(df)
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, real=frame.checkpoint: seen.append(self.columns) or real(self, *a))
    edges = structure.flows(df)
    edges.explain()
    assert "SortMergeJoin" in (plan := capsys.readouterr().out) and "Broadcast" not in plan
    assert edges.count() > 0 and not seen  # a checkpoint keeps rows as they lie in memory


def conversations(spark, tmp_path, n=60):
    turns = spark.range(n).select(F.floor(F.col("id") / 3).alias("conv_id"), (F.col("id") % 3).alias("turn"), F.lit("user").alias("role"),
                                  F.concat_ws(" ", F.lit("The"), *[F.concat(F.lit(w), (F.col("id") % k).cast("string")) for k, w in enumerate("abcdefghi", 2)]).alias("text"))
    turns.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    return tables.Tables(spark, str(tmp_path))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange" in line]


def test_grams_are_counted_where_their_text_is(spark, tmp_path):
    """Only texts are dealt, in tasks that grow in number with the files, not what is made of them."""
    counts = metric_queries.ngram_counts(conversations(spark, tmp_path))
    assert len(found := exchanges(counts)) == 1 and "REPARTITION_BY_NUM" in found[0]
    assert counts.where("idx = 0 and n = 1").agg(F.sum("cnt")).first()[0] == 10 and counts.count() > 60


def test_leaves_are_found_where_their_tree_is(spark, tmp_path):
    leaves = trees.leaf_tokens(conversations(spark, tmp_path).nodes)
    assert not any("hashpartitioning" in x and "REPARTITION_BY_NUM" not in x for x in exchanges(leaves))
    assert leaves.where("side = 'ref'").count() == 600


def test_whole_trees_are_what_levels_make(spark):
    """Random trees with repeated rows, null types, keys and names, in tasks and level by level, and nothing but examples dealt."""
    rng = random.Random(11)
    rows = []
    for ex in [*range(12), None]:
        for side in ("ref", "a", None):
            for i in range(rng.randrange(1, 14)):
                parent = None if i == 0 else rng.choice([rng.randrange(i), rng.randrange(max(0, i - 2), i), 99])
                row = (ex, side, rng.choice([i] * 9 + [None]), parent, rng.choice([0, 1, 1, None]), rng.choice(["x", "yé", "(", None]),
                       rng.choice([True, True, False, None]), rng.choice(["left", None]))
                rows += [row] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "ex bigint, side string, node_id bigint, parent_id bigint, ord bigint, type string, is_named boolean, field string")
    for options in ({}, {"digests": True}, {"fields": True}, {"digests": True, "fields": True}):
        want = sorted(map(str, trees.levelled_subtrees(df, **options).collect()))
        assert len(want) > 50
        for most in (trees.WHOLE, 30, 0):
            assert sorted(map(str, trees.subtrees(df, most=most, **options).collect())) == want
    plan = trees.subtrees(df.repartition("ex"), digests=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_texts_are_settled_where_they_lie(spark, monkeypatch):
    """Random block graphs, repeated rows and null keys, in place, in groups of names and spread; only texts are dealt."""
    rng = random.Random(5)
    rows, graph = [], []
    for ex in [*range(8), None]:
        for side in ("ref", None):
            n = rng.randrange(1, 40)
            for pos in range(n):
                row = (ex, side, pos // 3, rng.choice([pos] * 9 + [None]), rng.choice(["a", "b", "c", None]), rng.choice(["lhs", "rhs", "rhs", None]), pos // 6)
                rows += [row] * rng.choice([1, 1, 2])
            graph += [(ex, side, b, rng.randrange(n // 6 + 1)) for b in range(n // 6 + 1) for _ in range(2)]
    occ = spark.createDataFrame(rows, "ex bigint, side string, stmt bigint, pos bigint, name string, role string, block bigint")
    blocks = spark.createDataFrame(graph, "ex bigint, side string, block bigint, succ bigint")
    want = sorted(map(str, flow.spread_definitions(occ, blocks).collect()))
    assert len(want) > 100
    for most in (4096, 3, 1):
        assert sorted(map(str, flow.reaching_definitions(occ, blocks, most).collect())) == want
    monkeypatch.setattr(flow, "TOGETHER", 25)
    assert sorted(map(str, flow.reaching_definitions(occ, blocks).collect())) == want
    found = flow.reaching_definitions(occ.repartition(5, "ex"), blocks.repartition(5, "ex"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
