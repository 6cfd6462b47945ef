"""Trees to data flow: spans, scans, and flows against a small interpreter of random programs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslab.config import BRANCH_TYPES, KEEPS_BEFORE, LOOP_ENTRY
from corpuslab.operators import flow, runs, structure, trace, trees
from corpuslab.operators.scans import running
from corpuslab.plans.code_trees import LANGS, TYPES, WRAPPED

NODES = "ex bigint, side string, lang string, node_id bigint, parent_id bigint, ord bigint, type string, field string, is_named boolean, text string"


class Node:
    def __init__(self, kind, *kids, field=None, text=None):
        self.kind, self.kids, self.field, self.text = kind, list(kids), field, text


def leaf(name, field=None):
    return Node("identifier", field=field, text=name)


def rows_of(root, ex, lang):
    out = []

    def walk(node, parent, place):
        node.id = len(out)
        out.append((ex, "ref", lang, node.id, parent, place, node.kind, node.field, True, node.text))
        for i, kid in enumerate(node.kids):
            walk(kid, node.id, i)

    walk(root, None, 0)
    return out


def leaves(node):
    return [node] if node.text is not None and node.text != node.kind else [x for k in node.kids for x in leaves(k)]


class Interpreter:
    """States as name -> set of places, walked the way the languages' rules say."""

    def __init__(self, lang):
        self.lang, self.edges = lang, {}
        self.declares, self.assigns, self.counts, self.branches, self.repeats = TYPES[lang]

    def edge(self, leaf_, relation, parents):
        names, places = self.edges.setdefault((leaf_.text, leaf_.id, relation), (set(), set()))
        names.update(n for n, _ in parents)
        places.update(p for _, p in parents)

    def define(self, state, targets, sources, relation, always=False):
        for t in targets:
            if sources or always:
                self.edge(t, relation, [(s.text, s.id) for s in sources])
        return state | {t.text: {t.id} for t in targets}

    def run(self, node, state):
        side = {k.field: k for k in node.kids}
        if node.text is not None:
            if node.text != node.kind:
                self.edge(node, "comesFrom", [(node.text, p) for p in state[node.text]])
            return state
        if node.kind == self.declares:
            name, value = (node.kids + [None])[:2] if self.lang == "c_sharp" else (side.get("name"), side.get("value") or side.get("default_value"))
            state = self.run(value, state) if value else state
            return self.define(state, leaves(name), leaves(value) if value else [], "comesFrom", True)
        if node.kind == self.assigns:
            state = self.run(side["right"], state)
            return self.define(state, leaves(side["left"]), leaves(side["right"]), "computedFrom")
        if node.kind == self.counts and self.lang not in ("python", "ruby"):
            return self.define(state, leaves(node), leaves(node), "computedFrom")
        if node.kind in (self.branches, "else") and node.kids:
            return self.choose(node, state)
        if node.kind in ("for_statement", "for"):
            return self.loop(node, state)
        if node.kind == self.repeats:
            for _ in range(2):
                state = self.through(node.kids, state)
            return state
        return self.through(node.kids, state)

    def through(self, kids, state):
        for k in kids:
            state = self.run(k, state)
        return state

    def choose(self, node, start):
        split = next((i for i, k in enumerate(node.kids) if k.kind in BRANCH_TYPES[self.lang]), len(node.kids))
        ends = [self.through(node.kids[:split], start)] + [self.run(k, start) for k in node.kids[split:]]
        if self.lang in KEEPS_BEFORE or not any("else" in k.kind for k in [node, *node.kids]):
            ends.append(start)
        return {n: set().union(*(e.get(n, set()) for e in ends)) for n in set().union(*ends)}

    def loop(self, node, state):
        side = {k.field: k for k in node.kids}
        if self.lang in ("python", "ruby"):
            left, right = ("left", "right") if self.lang == "python" else ("pattern", "value")
            for _ in range(2):
                state = self.run(side[right], state)
                state = self.define(state, leaves(side[left]), leaves(side[right]), "computedFrom")
                state = self.run(side["body"], state)
            return state
        state = self.through(node.kids, state)
        at = next((i for i, k in enumerate(node.kids) if k.kind == LOOP_ENTRY[self.lang]), len(node.kids))
        if self.lang == "go" and at < len(node.kids):
            for k in node.kids[at].kids:
                state = self.run(k, state) if k.field == "update" else state
        return self.through(node.kids[at + 1:], state)


def program(lang, rng, size):
    declares, assigns, counts, branches, repeats = TYPES[lang]
    names = "abcd"
    name = lambda field=None: leaf(rng.choice(names), field)

    def expression(field):
        return name(field) if rng.random() < 0.5 else Node("binary_expression", name(), name(), field=field)

    def declaration(target=None, value=None):
        labels = {"c_sharp": (None, None), "php": ("name", "default_value")}.get(lang, ("name", "value"))
        value = expression(labels[1]) if value is None else value
        return Node(declares, leaf(target, labels[0]) if target else name(labels[0]), *([value] if value else []))

    def assignment():
        right = expression("right")
        if rng.random() < 0.15:
            right = assignment()
            right.field = "right"
        return Node(assigns, name("left"), Node("=", text="="), right)

    def statement(depth):
        kind = rng.choice(["assign"] * 3 + ["count", "use"] + ["if", "if", "while", "for"] * (depth > 0))
        if kind == "assign":
            return assignment()
        if kind == "count":
            return Node(counts, name())
        if kind == "use":
            return Node("expression_statement", expression(None))
        if kind == "if":
            kids = [Node("condition", expression(None), field="condition"), body(depth - 1, "consequence")]
            if rng.random() < 0.6:
                other = statement(depth - 1) if rng.random() < 0.3 else body(depth - 1, None)
                if lang in ("java", "c_sharp", "go"):
                    kids += [Node("else", text="else"), other]
                else:
                    kids.append(Node("else" if lang == "ruby" else "else_clause", other))
            return Node(branches, *kids)
        if kind == "while" and repeats:
            return Node(repeats, Node("condition", expression(None)), body(depth - 1, "body"))
        if lang in WRAPPED:
            head = [Node(WRAPPED[lang], declaration())] if rng.random() < 0.8 else []
            return Node("for_statement", *head, Node("condition", expression(None)), body(depth - 1, "body"))
        if lang == "php":
            return Node("for_statement", assignment(), Node("condition", expression(None)), body(depth - 1, "body"))
        if lang == "go":
            update = Node(counts, name(), field="update") if rng.random() < 0.7 else Node("none")
            head = [Node("for_clause", name("initializer"), name("condition"), update)] if rng.random() < 0.8 else []
            return Node("for_statement", *head, body(depth - 1, "body"))
        left, right = ("left", "right") if lang == "python" else ("pattern", "value")
        return Node("for" if lang == "ruby" else "for_statement", name(left), expression(right), body(depth - 1, "body"))

    def body(depth, field):
        return Node("block", *[statement(depth) for _ in range(rng.randint(1, 3))], field=field)

    start = [declaration(n, False) for n in names]
    return Node("program", *start, *[statement(3) for _ in range(size)])


def test_flows_of_random_programs(spark):
    rows, want = [], {}
    for i in range(84):
        rng, lang = random.Random(i), LANGS[i % 7]
        root = program(lang, rng, 6)
        rows += rows_of(root, i, lang)
        machine = Interpreter(lang)
        machine.run(root, {})
        want |= {(i, *k): (sorted(n), sorted(p)) for k, (n, p) in machine.edges.items()}
    found = structure.flows(spark.createDataFrame(rows, NODES).repartition(3)).collect()
    got = {(r.ex, r.name, r.pos, r.relation): (r.parent_names, r.parent_pos) for r in found}
    assert len(got) == len(found) and got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in got if got[k] != want[k]} == {}


@pytest.mark.parametrize("size", [1, structure.TOGETHER])
def test_whole_flows_of_random_programs(spark, monkeypatch, size):
    monkeypatch.setattr(structure, "TOGETHER", size)
    rows, want = [], {}
    for i in range(84):
        rng, lang = random.Random(i), LANGS[i % 7]
        root = program(lang, rng, 6)
        rows += rows_of(root, i, lang)
        machine = Interpreter(lang)
        machine.run(root, {})
        want |= {(i, *k): (sorted(n), sorted(p)) for k, (n, p) in machine.edges.items()}
    found = structure.whole_flows(spark.createDataFrame(rows, NODES).repartition(3)).collect()
    got = {(r.ex, r.name, r.pos, r.relation): (r.parent_names, r.parent_pos) for r in found}
    assert len(got) == len(found) and got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in got if got[k] != want[k]} == {}


def test_whole_trees_flow_as_spread_ones(spark):
    """Columns of whole examples against joins and scans: programs, repeated and null rows; only trees are dealt."""
    rows = [r for i, lang in enumerate(LANGS[:3]) for r in rows_of(program(lang, random.Random(i), 2), i, lang)]
    again = rows_of(Node("program", Node("while_statement", Node("condition", leaf("a")), Node("update_expression", leaf("a")))), 8, "java")
    rows += again * 2 + [(None, *r[1:]) for r in again] + [(9, None, *r[2:]) for r in again]
    df = spark.createDataFrame(rows, NODES)
    found = structure.reached_uses(df)
    got, want = Counter(found.collect()), Counter(structure.spread_uses(df).collect())
    assert got == want and max(n for r, n in got.items() if r.ex == 8) > 1
    for made in (structure.reached_uses(df), structure.whole_flows(df)):
        plan = str(made._jdf.queryExecution().executedPlan())
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_spans_and_marks(spark):
    root = Node("program", Node("while_statement", Node("condition", leaf("a")), Node("block", Node("assignment_expression", leaf("b", "left"), leaf("c", "right")))))
    tree = {r.node_id: r for r in structure.annotated(spark.createDataFrame(rows_of(root, 0, "java"), NODES)).collect()}
    assert [(tree[i].depth, tree[i].last) for i in range(8)] == [(1, 7), (2, 7), (3, 3), (4, 3), (3, 7), (4, 7), (5, 6), (5, 7)]
    assert [tuple(m) for m in tree[7].marks] == [(5, "assignment", "rhs"), (1, "while", None)]


def test_strings_are_leaves_and_comments_are_not(spark):
    text = Node("string_literal", leaf("inner"), field="value", text='"a inner"')
    root = Node("program", Node("variable_declarator", leaf("a", "name"), text), Node("comment", text="// a"), Node("call", leaf("a")))
    found = structure.flows(spark.createDataFrame(rows_of(root, 0, "java"), NODES)).collect()
    assert {(r.name, r.relation, tuple(r.parent_names), tuple(r.parent_pos)) for r in found} == {
        ("a", "comesFrom", ('"a inner"',), (3,)), ('"a inner"', "comesFrom", (), ()), ("a", "comesFrom", ("a",), (2,))}


@pytest.mark.parametrize("bits", [13, 0])
def test_trees_are_numbered_in_text_order(spark, monkeypatch, bits):
    monkeypatch.setattr(structure, "PIECE_BITS", bits)
    rng, rows, want = random.Random(3), [], {}
    for ex in range(3):
        made = rows_of(program("java", rng, 5), ex, "java")
        names = list(range(1000, 1000 + len(made)))
        rng.shuffle(names)
        for r in made:
            rows.append((*r[:3], names[r[3]], None if r[4] is None else names[r[4]], *r[5:]))
        want |= {(ex, r[3]): (r[4], r[6]) for r in made}
    got = structure.renumbered(spark.createDataFrame(rows, NODES)).collect()
    assert {(r.ex, r.node_id): (r.parent_id, r.type) for r in got} == want


def test_a_deep_tree_takes_few_rounds(spark):
    n = 3000
    nodes = spark.range(n).selectExpr("0L as ex", "'ref' as side", "'java' as lang", "id as node_id", "if(id = 0, null, id - 1) as parent_id",
                                      "0L as ord", "'n' as type", "cast(null as string) as field", "true as is_named", "cast(null as string) as text")
    assert structure.annotated(nodes).agg(F.max("depth"), F.min("last"), F.max("last")).first() == (n, n - 1, n - 1)


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_running_values_of_a_hot_key(spark, step):
    rng = random.Random(step)
    rows = [(k, i, rng.choice([None, *range(9)])) for k, n in (("hot", 700), ("cold", 3), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(4)
    got = running(df, ["k"], F.floor(F.col("i") / step), [F.col("i")], {
        "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "lately": ("last", F.col("v"))}).collect()
    for k, i, *found in got:
        earlier = [v for a, b, v in rows if a == k and b < i and v is not None]
        v, s, lo, hi, lately = found
        want = (sum(earlier), min(earlier), max(earlier), earlier[-1]) if earlier else (None,) * 4
        assert (s, lo, hi, lately) == want
    assert len(got) == len(rows)


def test_a_long_text_is_dealt_by_name(spark):
    """Facts in many groups give the rows of one group, and no group holds the text."""
    n = 30_000
    occ = spark.range(n).selectExpr("0L as ex", "'ref' as side", "id div 6 as stmt", "id as pos", "concat('v', id * 7 % 501) as name",
                                    "if(id % 6 = 0, 'lhs', 'rhs') as role", "id div 12 as block")
    graph = spark.range(n // 12).selectExpr("0L as ex", "'ref' as side", "id as block", "explode(array(id + 1, id + 2, id - id % 5)) as succ")
    few = flow.reaching_definitions(occ, graph, most=500)
    one = flow.reaching_definitions(occ, graph, most=10**9)
    assert few.exceptAll(one).isEmpty() and few.count() == one.count() == n - n // 6


GOLDEN = """(program
  (class_declaration
    name: (identifier)
    body: (class_body
      (method (modifiers "public" ")")
        type: (integral_type) ; name:(identifier)
        body: (block)))))"""


@pytest.mark.parametrize("bits", [13, 1, 0])
def test_golden_trees_are_read_back(spark, bits):
    deep = "(a " * 12 + ")" * 12
    wide = "(w " + " ".join(f"f{i}: (n{i} (x))" if i % 3 else f"(n{i})" for i in range(200)) + ")"
    texts = [GOLDEN, deep, wide, "(one)", "", "no node"]
    df = spark.createDataFrame([(i, "ref", t) for i, t in enumerate(texts)], "ex bigint, side string, tree string")
    nodes = trees.parsed(df, ["ex", "side"], piece_bits=bits)
    first = [(r.node_id, r.parent_id, r.ord, r.type, r.field) for r in nodes.where("ex = 0").orderBy("node_id").collect()]
    assert first == [
        (0, None, 0, "program", None), (1, 0, 0, "class_declaration", None), (2, 1, 0, "identifier", "name"), (3, 1, 1, "class_body", "body"),
        (4, 3, 0, "method", None), (5, 4, 0, "modifiers", None), (6, 4, 1, "integral_type", "type"), (7, 4, 2, "identifier", "name"),
        (8, 4, 3, "block", "body"),
    ]
    shown = {r.ex: r.sexp for r in trees.subtrees(nodes, fields=True).where("depth = 1").collect()}
    assert shown[0] == ("(program (class_declaration name: (identifier) body: (class_body (method (modifiers) type: (integral_type) "
                        "name: (identifier) body: (block)))))")
    assert shown[1] == "(a " * 11 + "(a)" + ")" * 11 and shown[2] == wide and shown[3] == "(one)" and len(shown) == 4
    plain = {r.ex: r.sexp for r in trees.subtrees(nodes).where("depth = 1").collect()}
    assert plain[0].count(":") == 0 and plain[0].count("(") == 9


def test_texts_are_read_where_they_lie(spark, monkeypatch):
    """Nodes of texts column by column against scans in pieces: random brackets, repeated, null and empty rows; nothing but texts is dealt."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(["(", "(", ")", "a", "b: ", "c::", "'q)'", " "]) for _ in range(rng.choice([0, 3, 40, 200]))) for _ in range(30)]
    rows = [(i, rng.choice(["x", "y"]), x) for i, x in enumerate(texts)]
    rows += [*rows[:9], (None, "x", texts[5]), (3, None, texts[6]), (4, "z", None)]
    df = spark.createDataFrame(rows, "ex bigint, side string, tree string")
    want = trees.parsed_in_pieces(df, ["ex", "side"], piece_bits=3)
    for size in (1, 50, trees.TOGETHER):
        monkeypatch.setattr(trees, "TOGETHER", size)
        for got in (trees.parsed(df, ["ex", "side"]), trees.parsed(df.repartition(3, "ex"), ["ex", "side"], dealt=True)):
            assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = str(got._jdf.queryExecution().executedPlan())
    assert plan.count("Exchange") == 1 and "Window" not in plan
    whole, apart = trees.subtrees(got, fields=True, dealt=True), trees.subtrees(want, fields=True)
    assert whole.exceptAll(apart).isEmpty() and apart.exceptAll(whole).isEmpty()
    assert str(whole._jdf.queryExecution().executedPlan()).count("Exchange") == 1


def test_one_layout_gives_the_same_matches(spark):
    """Windows over rows dealt once, against joins and groupings of each step."""
    rng = random.Random(9)
    rows = [(ex, side, p // 5, p, rng.choice("abcde"), "lhs" if p % 5 == 0 else "rhs")
            for ex in range(12) for side in ("ref", "m1", "m2", "other") for p in range(rng.choice([0, 1, 7, 33]))]
    occ = spark.createDataFrame(rows, "ex bigint, side string, stmt bigint, pos bigint, name string, role string")
    joined = flow.use_def(occ).filter("role = 'rhs'").drop("role").unionByName(flow.assignments(occ))
    edges = flow.straight_flows(occ)
    assert edges.exceptAll(joined).isEmpty() and joined.exceptAll(edges).isEmpty()
    named, renamed = flow.normalize_names(flow.connected_nodes(joined)), flow.numbered_names(flow.connected_nodes(edges))
    assert named.exceptAll(renamed).isEmpty() and renamed.exceptAll(named).isEmpty()
    pairs = spark.createDataFrame([(m, i) for m in ("m1", "m2") for i in range(14)], "model string, idx bigint")
    for refs in ("ref", ["ref", "other"]):
        want = flow.dataflow_match(pairs, flow.prepared_bags(joined), refs)
        got = flow.flow_match(pairs, edges, refs)
        assert got.count() == 28 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_scans_in_pieces_give_the_same_rows(spark):
    """A key that holds nearly all rows: definitions of a name, coverage of a position, one long run."""
    rng = random.Random(5)
    occ = spark.createDataFrame([(0, "ref", p // 5, p, "x" if p % 11 else "y", rng.choice(["lhs", "rhs", "rhs"])) for p in range(900)],
                                "ex bigint, side string, stmt bigint, pos bigint, name string, role string").repartition(3)
    weights = spark.createDataFrame([(0, s, 0 if s % 20 else 1, float(rng.randint(0, 8))) for s in range(600)],
                                    "ex bigint, step bigint, src bigint, weight double").repartition(3)
    log = spark.createDataFrame([("hot" if e % 50 else "cold", e, float(rng.randint(0, 9))) for e in range(700)] + [(None, 1, 1.0)],
                                "run string, epoch bigint, valid_loss double").repartition(3)
    for size in (1, 13, 10_000):
        for whole, cut in ((flow.use_def(occ), flow.use_def(occ, size)), (trace.coverage(weights), trace.coverage(weights, pieces=size)),
                           (runs.checkpoint_plan(log), runs.checkpoint_plan(log, pieces=size))):
            assert sorted(whole.columns) == sorted(cut.columns)
            cut = cut.select(*whole.columns)
            assert whole.count() == cut.count() and whole.exceptAll(cut).isEmpty()


def test_columns_give_the_names_of_windows(spark, monkeypatch):
    """Whole examples column by column, in pieces of any size, with repeated, null and lone rows."""
    rng = random.Random(4)
    rows = [(ex, side, p // 5, p, rng.choice(["a", "b", "c", "é", "Z", None]), rng.choice(["lhs", "rhs", "rhs", "rhs"]) if p % 5 else "lhs")
            for ex in [*range(9), None, 10**12] for side in ("ref", "m1", None) for p in range(rng.choice([0, 1, 7, 33]))]
    rows += rng.choices(rows, k=60) + [(3, "ref", None, 7, "a", "rhs"), (4, "ref", 1, None, "b", "rhs"), (5, "m1", 2, 11, "c", None)]
    occ = spark.createDataFrame(rows, "ex bigint, side string, stmt bigint, pos bigint, name string, role string")
    want = flow.numbered_names(flow.connected_nodes(flow.straight_flows(occ)))
    for size in (1, 40, flow.TOGETHER):
        monkeypatch.setattr(flow, "TOGETHER", size)
        got = flow.straight_names(occ)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert flow.straight_names(occ.where("ex < 0")).count() == 0
    assert str(got._jdf.queryExecution().executedPlan()).count("Window") == 0
