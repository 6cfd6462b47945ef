"""From syntax trees to data flow: nested spans, occurrences of variables, block graphs, edges.

A node table has ex, side, lang, node_id (growing in text order, as parsers assign them), parent_id,
ord, type, field (the child's label or null), is_named and text (of leaves).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.config import (
    BRANCH_TYPES, COMMENT_NODE_TYPE, KEEPS_BEFORE, LOOP_ENTRY, SIDE_FIELDS, SIDE_PLACES, STRING_NODE_TYPES,
)
from corpuslab.functions.tables import literal_table
from corpuslab.operators import flow, wholeflow
from corpuslab.operators.columns import TOGETHER, whole_examples
from corpuslab.operators.scans import running
from corpuslab.session import stored

TREE = ["ex", "side"]
LOOPS = ("for", "for_each", "while")
#: The role of nodes whose text counts as a whole.
STRING = "string"
#: Roles of statements that have sides.
SIDED = ("declaration", "assignment", "for_each", "for")
#: Bits of a block's number below those of the node it starts at; they tell apart ends at one node.
END_BITS = 20
#: Nodes of one piece of a text's order: 2 to the power of this.
PIECE_BITS = 13


def _kept(df: DataFrame, label: str) -> DataFrame:
    """`stored`, and never broadcast: its files are many times smaller than its rows, and planners see the files."""
    return stored(df, label).hint("merge")


def renumbered(nodes: DataFrame) -> DataFrame:
    """The tree with `node_id` and `parent_id` numbered from 0 in text order, by `ord` of siblings.

    Sizes of subtrees and then numbers are summed over ancestors at distances 1, 2, 4, …, so the number
    of rounds is logarithmic in the depth and no tree is gathered.
    """
    link = nodes.select(*TREE, "node_id", "parent_id", "ord")
    sizes = _doubled(link.select(*TREE, "node_id", F.col("parent_id").alias("up"), F.lit(1).cast("bigint").alias("size")),
                     below={"size": F.sum})
    known = link.join(sizes.select(*TREE, "node_id", "size"), [*TREE, "node_id"]).withColumns(
        {"_root": F.col("parent_id").isNull(), "_kin": F.coalesce("parent_id", F.lit(0))})
    offset = running(known, [*TREE, "_root", "_kin"], F.shiftright("ord", PIECE_BITS), [F.col("ord"), F.col("node_id")],
                     {"elder": ("sum", F.col("size"))})
    start = offset.select(*TREE, "node_id", F.col("parent_id").alias("up"),
                          (F.coalesce("elder", F.lit(0)) + F.when(F.col("parent_id").isNull(), 0).otherwise(1)).alias("number"))
    numbers = _doubled(start, above={"number": lambda mine, over: mine + over}).select(*TREE, "node_id", "number")
    parents = numbers.select(*TREE, F.col("node_id").alias("parent_id"), F.col("number").alias("_parent"))
    return (
        nodes.join(numbers, [*TREE, "node_id"]).join(parents, [*TREE, "parent_id"], "left")
        .select(*[F.col("number").alias(c) if c == "node_id" else F.col("_parent").alias(c) if c == "parent_id" else F.col(c)
                  for c in nodes.columns])
    )


def _doubled(state: DataFrame, above: dict | None = None, below: dict | None = None) -> DataFrame:
    """Values of nodes put together with those of all ancestors (`above`: column -> (mine, theirs) -> both) and
    of all descendants (`below`: column -> aggregate), by pointer doubling over `up`.

    After k rounds a node's `up` is its 2**k-th ancestor and its values cover 2**k generations.
    """
    above, below = above or {}, below or {}
    state = _kept(state, "climb")
    while True:
        moving = state.where("up is not null")
        if moving.isEmpty():
            return state.drop("up")
        over = state.select(*TREE, F.col("node_id").alias("up"), F.col("up").alias("_up"),
                            *[F.col(c).alias(f"_a_{c}") for c in above])
        nxt = state.join(over, [*TREE, "up"], "left")
        if below:
            sums = moving.groupBy(*TREE, F.col("up").alias("node_id")).agg(*[f(c).alias(f"_b_{c}") for c, f in below.items()])
            nxt = nxt.join(sums, [*TREE, "node_id"], "left")
        values = []
        for c in state.columns:
            if c in (*TREE, "node_id"):
                values.append(F.col(c))
            elif c == "up":
                values.append(F.col("_up").alias("up"))
            elif c in above:
                values.append(F.when(F.col("up").isNull(), F.col(c)).otherwise(above[c](F.col(c), F.col(f"_a_{c}"))).alias(c))
            else:
                join = {F.sum: lambda a, b: a + F.coalesce(b, F.lit(0)), F.max: F.greatest}[below[c]]
                values.append(join(F.col(c), F.col(f"_b_{c}")).alias(c))
        state = _kept(nxt.select(*values), "climb")


def _side(lang: Column, role: Column, field: Column, ord: Column) -> Column:
    """lhs, rhs or body: what a child of a statement is to it; null where evaluation passes it by."""
    side = F.lit(None).cast("string")
    for (of_lang, of_role), fields in SIDE_FIELDS.items():
        here = (role == of_role) & ((lang == of_lang) if of_lang else F.lit(True))
        for name, value in fields.items():
            side = F.when(here & (field == name), value).otherwise(side)
    for (of_lang, of_role), places in SIDE_PLACES.items():
        for place, value in places.items():
            side = F.when((lang == of_lang) & (role == of_role) & (ord == place), value).otherwise(side)
    return side


def _told(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    return flow.classify_nodes(nodes, rules).withColumn(
        "role", F.coalesce("role", F.when(F.col("type").isin(*STRING_NODE_TYPES), STRING)))


def annotated(nodes: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Nodes with `role` (by `rules`), `last` (the largest id inside), `depth` (root 1), `side` (what the node is
    to a statement it is a child of) and `marks`: (node, role, side) of every ancestor with a role,
    nearest first. One climb by pointer doubling finds all of them."""
    rules = flow.rule_table(nodes.sparkSession, fill_gaps=True) if rules is None else rules
    told = _told(nodes, rules)
    parents = told.where("role is not null").select(*TREE, F.col("node_id").alias("parent_id"), F.col("role").alias("parent_role"))
    kin = told.join(parents, [*TREE, "parent_id"], "left").withColumn(
        "edge", _side(F.col("lang"), F.col("parent_role"), F.col("field"), F.col("ord")))
    kin = _kept(kin, "kin")
    mark = F.struct(F.col("parent_id").alias("node"), F.col("parent_role").alias("role"), F.col("edge").alias("side"))
    none = F.array().cast("array<struct<node:bigint,role:string,side:string>>")
    climbed = _doubled(
        kin.select(*TREE, "node_id", F.col("parent_id").alias("up"), F.col("node_id").alias("last"),
                   F.lit(1).cast("bigint").alias("depth"),
                   F.when(F.col("parent_role").isNotNull(), F.array(mark)).otherwise(none).alias("marks")),
        above={"depth": lambda a, b: a + b, "marks": lambda a, b: F.concat(a, b)}, below={"last": F.max},
    )
    return _kept(kin.join(climbed, [*TREE, "node_id"]), "annotated")


def variable_uses(tree: DataFrame) -> DataFrame:
    """Leaves with a text other than their type; a string counts as a leaf, comments do not."""
    texts = F.col("text").isNotNull() & (F.col("text") != F.col("type")) & (F.col("type") != COMMENT_NODE_TYPE)
    return tree.where(texts & ~F.exists("marks", lambda m: m["role"] == STRING))


def statement_times(tree: DataFrame) -> DataFrame:
    """ex, side, stmt, time: the place after which a statement's targets are defined: the end of its right
    side, or of its left one where it has no other; increments: their own end."""
    sides = tree.where(F.col("edge").isin("lhs", "rhs")).groupBy(*TREE, F.col("parent_id").alias("stmt")).agg(
        F.coalesce(F.max(F.when(F.col("edge") == "rhs", F.col("last"))), F.max("last")).alias("time"))
    own = tree.where("role = 'increment'").select(*TREE, F.col("node_id").alias("stmt"), F.col("last").alias("time"))
    return sides.unionByName(own)


def occurrences(tree: DataFrame) -> DataFrame:
    """Variables of an annotated tree as they are evaluated: ex, side, lang, pos (the leaf's id), name, role (lhs if
    defined there, else rhs), stmt (the statement that defines it), kind (that statement's role), time (the
    place at which it counts), eo (order among all), sources (statements it is a source of).

    From the root down, the first statement that has a leaf on its left side, or an increment that
    holds it, defines it; what a statement has on neither side and in no body is passed by.
    """
    path = F.reverse("marks")
    stops = F.filter(path, lambda m: (m["role"] == "increment") | (m["role"].isin(*SIDED) & F.coalesce(m["side"] == "lhs", F.lit(False))))
    sided = lambda m: m["role"].isin("declaration", "assignment", "for_each") | ((m["role"] == "for") & F.col("lang").isin("python", "ruby"))
    passed = F.exists(path, lambda m: sided(m) & m["side"].isNull())
    found = (
        variable_uses(tree).withColumn("_stop", F.get(stops, F.lit(0)))
        .where(F.col("_stop").isNotNull() | ~passed)
        .withColumn("sources", F.transform(
            F.filter(path, lambda m: m["role"].isin(*SIDED) & (m["side"] == "rhs")
                     & (F.col("_stop").isNull() | (m["node"] < F.col("_stop.node")))), lambda m: m["node"]))
        .select(*TREE, "lang", F.col("node_id").alias("pos"), F.col("text").alias("name"),
                F.when(F.col("_stop").isNull(), "rhs").otherwise("lhs").alias("role"), F.col("_stop.node").alias("stmt"),
                F.col("_stop.role").alias("kind"), "sources", F.size("marks").alias("deep"))
    )
    timed = found.join(statement_times(tree), [*TREE, "stmt"], "left")
    time = F.coalesce("time", "pos")
    inner_first = F.when(F.col("role") == "lhs", 512 + 511 - F.least("deep", F.lit(511))).otherwise(0)
    return timed.select(*TREE, "lang", "pos", "name", "role", "stmt", "kind", "sources", time.alias("time"),
                        (F.shiftleft(time, 10) + inner_first).alias("eo"))


def _start(node: Column) -> Column:
    return F.shiftleft(node, END_BITS)


def _end(last: Column, depth: Column) -> Column:
    """The number of the block after a construct: behind all that starts inside it, inner ones first."""
    return F.shiftleft(last, END_BITS) + (1 << END_BITS) - 1 - F.least(depth, F.lit((1 << END_BITS) - 2))


def control_graph(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cuts, edges) of an annotated tree. Cuts: ex, side, block: where blocks start, in text order. Edges: ex,
    side, block, succ.

    An if has its condition and first body as one branch and each child of a branch type, and what
    follows it, as another; all start from the state before it. That state also goes on behind the if
    where no child is an else, and in some languages always. A loop's end goes back to its start, or
    behind its declaration; the state behind a loop is that of its end.
    """
    control = tree.where(F.col("role").isin("if", *LOOPS)).select(
        *TREE, "lang", F.col("node_id").alias("node"), "role", "type", "last", "depth")
    kids = tree.where("parent_role is not null").select(
        *TREE, F.col("parent_id").alias("node"), F.col("node_id").alias("kid"), F.col("type").alias("kid_type"), "ord")
    branch = literal_table(tree.sparkSession, ["lang", "kid_type", "starts"],
                           [(lang, t, True) for lang, ts in BRANCH_TYPES.items() for t in ts])
    entry = literal_table(tree.sparkSession, ["lang", "kid_type", "enters"], [(lang, t, True) for lang, t in LOOP_ENTRY.items()])
    both = control.join(kids, [*TREE, "node"]).join(branch, ["lang", "kid_type"], "left").join(entry, ["lang", "kid_type"], "left")
    shape = both.groupBy(*TREE, "lang", "node", "role", "type", "last", "depth").agg(
        F.min("kid").alias("first"), F.min(F.when(F.col("starts"), F.col("kid"))).alias("flag"),
        F.max(F.col("kid_type").contains("else")).alias("has_else"),
        F.min(F.when(F.col("enters"), F.col("kid"))).alias("entry"),
        F.sort_array(F.collect_list("kid")).alias("kids"),
    )
    update = tree.where("field = 'update' and lang = 'go'").select(*TREE, F.col("parent_id").alias("entry"), F.col("node_id").alias("update"))
    shape = shape.join(update, [*TREE, "entry"], "left")
    behind_entry = F.get(F.filter("kids", lambda k: k > F.col("entry")), F.lit(0))
    needs_entry = (F.col("role") == "for") & F.col("lang").isin(*LOOP_ENTRY)
    back = F.when(F.col("role").isin(*LOOPS), F.when(needs_entry, F.coalesce("update", behind_entry)).otherwise(F.col("first")))
    shape = shape.select(
        *TREE, _start(F.col("node")).alias("before"), _end(F.col("last"), F.col("depth")).alias("after"),
        _start(F.col("first")).alias("first"), _start(back).alias("back"), F.col("role").isin(*LOOPS).alias("loops"),
        F.transform(F.filter("kids", lambda k: (F.col("role") == "if") & (k >= F.col("flag"))), _start).alias("branches"),
        (~(F.coalesce("has_else", F.lit(False)) | F.col("type").contains("else")) | F.col("lang").isin(*KEEPS_BEFORE)).alias("keeps"),
    )
    shape = _kept(shape, "control")

    def cut(block: Column, falls: bool, back: Column | None = None, after: Column | None = None, before: Column | None = None):
        none = F.lit(None).cast("bigint")
        return F.struct(block.alias("block"), F.lit(falls).alias("falls"), (none if back is None else back).alias("back"),
                        (none if after is None else after).alias("after"), (none if before is None else before).alias("before"))

    pieces = F.concat(
        F.array(cut(F.col("before"), True), cut(F.col("first"), True), cut(F.col("after"), True, back=F.col("back"))),
        F.when(F.col("back").isNotNull(), F.array(cut(F.col("back"), True))).otherwise(F.array().cast("array<struct<block:bigint,falls:boolean,back:bigint,after:bigint,before:bigint>>")),
        F.transform("branches", lambda b: cut(b, False, after=F.col("after"), before=F.col("before"))),
    )
    roots = tree.where("parent_id is null").select(*TREE, F.inline(F.array(cut(_start(F.col("node_id")), True))))
    merged = shape.select(*TREE, F.inline(pieces)).unionByName(roots).groupBy(*TREE, "block").agg(
        F.min("falls").alias("falls"), F.max("back").alias("back"), F.max("after").alias("after"), F.max("before").alias("before"))
    lined = running(merged, TREE, F.shiftright("block", END_BITS + PIECE_BITS), [F.col("block")], {"prior": ("max", F.col("block"))})
    lined = _kept(lined, "cuts")

    def edge(a: Column, b: Column, when: Column):
        return F.when(when & a.isNotNull() & b.isNotNull(), F.struct(a.alias("block"), b.alias("succ")))

    along = lined.select(*TREE, F.inline(F.filter(F.array(
        edge(F.col("prior"), F.col("block"), F.col("falls")), edge(F.col("prior"), F.col("back"), F.lit(True)),
        edge(F.col("prior"), F.col("after"), F.lit(True)), edge(F.col("before"), F.col("block"), F.lit(True)),
    ), lambda e: e.isNotNull())))
    skips = shape.where("keeps and not loops").select(*TREE, F.col("before").alias("block"), F.col("after").alias("succ"))
    return lined.select(*TREE, "block"), along.unionByName(skips).distinct()


def placed(occ: DataFrame, cuts: DataFrame) -> DataFrame:
    """Occurrences with the `block` they are evaluated in: the latest that starts at or before their time."""
    events = occ.select(*TREE, _start(F.col("time")).alias("at"), F.lit(1).alias("kind"), F.struct(*occ.columns).alias("o"),
                        F.lit(None).cast("bigint").alias("cut"))
    marks = cuts.select(*TREE, F.col("block").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(events.schema["o"].dataType).alias("o"),
                        F.col("block").alias("cut"))
    both = running(events.unionByName(marks), TREE, F.shiftright("at", END_BITS + PIECE_BITS), [F.col("at"), F.col("kind")],
                   {"block": ("last", F.col("cut"))})
    return both.where("kind = 1").select("o.*", "block")


def statement_edges(occ: DataFrame) -> DataFrame:
    """Edges that statements make by themselves: each target of a declaration from each variable of its value (or
    from nothing), of an assignment or for-each from each source, of an increment from all its variables.
    Python and Ruby give one edge with all sources, which is what single edges merge to."""
    targets = occ.where("role = 'lhs'").select(*TREE, "stmt", "kind", "name", "pos")
    sources = occ.select(*TREE, F.explode("sources").alias("stmt"), F.col("name").alias("pn"), F.col("pos").alias("pp"))
    counted = occ.where("kind = 'increment'").select(*TREE, "stmt", F.col("name").alias("pn"), F.col("pos").alias("pp"))
    given = sources.unionByName(counted).groupBy(*TREE, "stmt").agg(F.sort_array(F.collect_list(F.struct("pp", "pn"))).alias("src"))
    joined = targets.join(given, [*TREE, "stmt"], "left").where("src is not null or kind = 'declaration'")
    return joined.select(
        *TREE, "name", "pos", F.when(F.col("kind") == "declaration", "comesFrom").otherwise("computedFrom").alias("relation"),
        F.coalesce(F.transform("src", lambda s: s["pn"]), F.array().cast("array<string>")).alias("parent_names"),
        F.coalesce(F.transform("src", lambda s: s["pp"]), F.array().cast("array<bigint>")).alias("parent_pos"),
    )


#: Nodes of one example that a task holds, at most; the trees of larger ones are spread over tasks.
WHOLE = 1 << 17


def _whole_or_large(nodes: DataFrame, rules: DataFrame | None, most: int, made: bool) -> tuple[DataFrame, DataFrame | None]:
    """Edges (with `lang`) of examples of at most `most` nodes, made where the example was dealt, and the nodes of larger ones, if any."""
    rules = flow.rule_table(nodes.sparkSession, fill_gaps=True) if rules is None else rules
    sized = nodes.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("ex")))
    told = _told(sized.where(F.col("_size") <= most), rules).select(*wholeflow.COLUMNS)

    def run(batches):
        for table, new in whole_examples(batches, TOGETHER):
            yield from wholeflow.reached(table, new, lambda texts: flow._settled(texts, flow.MOST_FACTS), END_BITS, made)

    types = {f.name: f.dataType.simpleString() for f in nodes.schema}
    whole = told.mapInArrow(run, f"ex {types['ex']}, side {types['side']}, lang {types['lang']}, name string, pos bigint, relation string, "
                                 "parent_names array<string>, parent_pos array<bigint>, times bigint")
    large = nodes.groupBy("ex").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > most)
    if not large.count():  # by all tasks at once, where a look for one row starts with one task
        return whole, None
    return whole, sized.where(F.col("_size") > most).drop("_size")


def whole_flows(nodes: DataFrame, rules: DataFrame | None = None, most: int = WHOLE) -> DataFrame:
    """`flows`, with whole examples annotated, cut into blocks and settled where they were dealt, column by column (plans
    that do not deal by `ex` yet deal once); only examples of more than `most` nodes are spread over tasks, by `flows`."""
    whole, large = _whole_or_large(nodes, rules, most, made=True)
    whole = whole.select(*flow.EDGE)
    return whole if large is None else whole.unionByName(flows(large, rules))


def flows(nodes: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Data-flow edges of trees: what statements make, and each use from every definition that reaches it over
    branches and loops; equal edges merged. Each tree is spread over tasks."""
    tree = annotated(nodes, rules)
    cuts, edges = control_graph(tree)
    occ = _kept(placed(occurrences(tree), cuts), "occurrences")
    reached = flow.reaching_definitions(occ, edges)
    return flow.merge_edges(statement_edges(occ).unionByName(reached.select(*flow.EDGE)))


def reached_uses(nodes: DataFrame, rules: DataFrame | None = None, most: int = WHOLE) -> DataFrame:
    """lang, ex, side, name, pos, parent: each use with every definition that reaches it, trees as in `whole_flows`. What comes
    of repeated nodes is repeated as joins of the single steps repeat it, last of all, so filters come before."""
    whole, large = _whole_or_large(nodes, rules, most, made=False)
    found = whole.select("lang", "ex", "side", "name", "pos", F.explode("parent_pos").alias("parent"), "times")
    found = found.withColumn("_time", F.explode(F.expr("sequence(1L, times)"))).drop("times", "_time")
    return found if large is None else found.unionByName(spread_uses(large, rules))


def spread_uses(nodes: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """`reached_uses` of large trees, each spread over tasks."""
    tree = annotated(nodes, rules)
    cuts, edges = control_graph(tree)
    occ = _kept(placed(occurrences(tree), cuts), "occurrences")
    reached = flow.reaching_definitions(occ, edges).select("ex", "side", "name", "pos", F.explode("parent_pos").alias("parent"))
    return reached.join(occ.select("ex", "side", "pos", "lang"), ["ex", "side", "pos"]).select("lang", "ex", "side", "name", "pos", "parent")
