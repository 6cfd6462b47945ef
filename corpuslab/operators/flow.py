"""Data-flow edges from tables of variable occurrences, and their comparison."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.config import STATEMENT_GAPS, STATEMENT_TYPES
from corpuslab.functions.arrays import let
from corpuslab.functions.tables import literal_table
from corpuslab.operators.columns import NO_PLACE, TOGETHER, coded, firsts, ranges, whole_examples
from corpuslab.operators.scans import running
from corpuslab.session import cut_lineage

UNIT = ["ex", "side"]
EDGE = ["ex", "side", "name", "pos", "relation", "parent_names", "parent_pos"]


def evaluation_order() -> Column:
    """Right side of a statement before its left side."""
    return F.col("stmt") * 2 + F.when(F.col("role") == "lhs", 1).otherwise(0)


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _no_pos() -> Column:
    return F.array().cast("array<bigint>")


def use_def(occ: DataFrame, pieces: int | None = None) -> DataFrame:
    """Each occurrence with the latest earlier definition of its name (an as-of join done as
    one window). The first sight of a name defines it, without a parent.

    With `pieces`, so many statements are walked together and a name that is everywhere in a long text is
    spread over tasks; without, one task orders the uses of a name in a text."""
    if pieces is not None:
        sights = running(
            occ.withColumn("_eo", evaluation_order()), [*UNIT, "name"], F.floor(F.col("stmt") / pieces), [F.col("_eo"), F.col("pos")],
            {"_last": ("last", F.when(F.col("role") == "lhs", F.col("pos"))), "_first": ("min", F.struct("_eo", "pos"))},
        )
        return _used(sights.withColumn("_par", F.coalesce("_last", "_first.pos")))
    name_order = Window.partitionBy(*UNIT, "name").orderBy("_eo", "pos")
    before = name_order.rowsBetween(Window.unboundedPreceding, -1)
    defines = (F.col("role") == "lhs") | (F.row_number().over(name_order) == 1)
    seen = (
        occ.withColumn("_eo", evaluation_order())
        .withColumn("_def", F.when(defines, F.col("pos")))
        .withColumn("_par", F.last("_def", ignorenulls=True).over(before))
    )
    return _used(seen)


def _used(seen: DataFrame) -> DataFrame:
    none = F.col("_par").isNull()
    return seen.select(
        *UNIT, "name", "pos", F.lit("comesFrom").alias("relation"),
        F.when(none, _no_names()).otherwise(F.array("name")).alias("parent_names"),
        F.when(none, _no_pos()).otherwise(F.array("_par")).alias("parent_pos"),
        "role",
    )


def _with_sources(occ: DataFrame, keys: list[str], taken: Column) -> DataFrame:
    """Occurrences with `_src`, the (pos, name) of those rows of the same keys that are `taken`; null keys have none.

    One window deals the rows once. A join would be planned by a size guessed before texts are unrolled
    into words, and one side, as large as the input, be broadcast through the driver."""
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    sources = F.collect_list(F.when(known & taken, F.struct("pos", "name")))
    return occ.withColumn("_src", sources.over(Window.partitionBy(*keys)))


def _single_edges(left: DataFrame, relation: str, source: Column) -> DataFrame:
    none = F.col("_s").isNull()
    return left.select(*UNIT, "name", "pos", source.alias("_s")).select(
        *UNIT, "name", "pos", F.lit(relation).alias("relation"),
        F.when(none, _no_names()).otherwise(F.array("_s.name")).alias("parent_names"),
        F.when(none, _no_pos()).otherwise(F.array("_s.pos")).alias("parent_pos"),
    )


def _grouped_edges(left: DataFrame) -> DataFrame:
    return left.where(F.size("_src") > 0).select(*UNIT, "name", "pos", F.sort_array("_src").alias("_src")).select(
        *UNIT, "name", "pos", F.lit("computedFrom").alias("relation"),
        F.transform("_src", lambda s: s.getField("name")).alias("parent_names"),
        F.transform("_src", lambda s: s.getField("pos")).alias("parent_pos"),
    )


def declarations(occ: DataFrame) -> DataFrame:
    """One `comesFrom` edge per declared name and initialiser variable, or one without parent."""
    left = _with_sources(occ, [*UNIT, "stmt"], F.col("role") == "rhs").where("role = 'lhs'")
    return _single_edges(left, "comesFrom", F.explode_outer("_src"))


def assignments(occ: DataFrame) -> DataFrame:
    """One `computedFrom` edge per target and source variable of a statement."""
    left = _with_sources(occ, [*UNIT, "stmt"], F.col("role") == "rhs").where("role = 'lhs'")
    return _single_edges(left, "computedFrom", F.explode("_src"))


def assignments_grouped(occ: DataFrame, item: str | None = None) -> DataFrame:
    """One `computedFrom` edge per target with all its sources.

    `item` names a column with the place in a tuple: sources then go to the target of the same
    place where both sides of the statement have equally many places.
    """
    keys = [*UNIT, "stmt"]
    if item:
        statement = Window.partitionBy(*keys)

        def places(role: str) -> Column:
            return F.size(F.collect_set(F.when(F.col("role") == role, F.col(item))).over(statement))

        occ = occ.withColumn("_item", F.when(places("lhs") == places("rhs"), F.col(item)).otherwise(0))
        keys = [*keys, "_item"]
    return _grouped_edges(_with_sources(occ, keys, F.col("role") == "rhs").where("role = 'lhs'"))


def increments(occ: DataFrame) -> DataFrame:
    """Every variable of an increment statement from every one of them.

    One edge per variable with all parents, which is what its single edges merge to.
    """
    return _grouped_edges(_with_sources(occ, [*UNIT, "stmt"], F.lit(True)))


#: Facts (a name in a block) of one text that are settled together, about.
MOST_FACTS = 4096


def _reached(facts: list[tuple], edges: list[tuple]) -> list[tuple[int | None, list[int]]]:
    """For facts (name, block, definition, candidate for a first sight): the first sight's place, and the
    definitions that reach the block's start. A bit stands for a name, then for a definition."""
    before: dict[int, list[int]] = {f[1]: [] for f in facts}
    for block, succ in edges:
        before.setdefault(block, [])
        before.setdefault(succ, []).append(block)
    order = sorted(before)
    inside: dict[int, list[int]] = {}
    for i, f in enumerate(facts):
        inside.setdefault(f[1], []).append(i)
    number: dict[str, int] = {}
    known: dict[int, int] = {}
    sights: list[int | None] = [None] * len(facts)
    for b in order:
        names = 0
        for p in before[b]:
            names |= known.get(p, 0)  # blocks that follow in the text have not been read yet
        here = 0
        for i in inside.get(b, ()):
            name, _, _, sight = facts[i]
            bit = 1 << number.setdefault(name, len(number))
            if not names & bit:
                sights[i] = sight
            here |= bit
        known[b] = names | here
    places: list[int] = []
    of_name: dict[str, int] = {}
    gen, stopped = dict.fromkeys(order, 0), {}
    for i, (name, b, place, _) in enumerate(facts):
        if place is not None:
            stopped.setdefault(b, []).append(name)
        place = sights[i] if place is None else place
        if place is not None:
            of_name[name] = of_name.get(name, 0) | 1 << len(places)
            gen[b] |= 1 << len(places)
            places.append(place)
    every = (1 << len(places)) - 1
    keep = {b: every & ~sum(of_name[n] for n in names) for b, names in stopped.items()}
    entry, leave = dict.fromkeys(order, 0), dict(gen)
    changed = True
    while changed:  # in text order: once, and once more for each level of loops that matters
        changed = False
        for b in order:
            now = 0
            for p in before[b]:
                now |= leave[p]
            if now != entry[b]:
                entry[b], changed = now, True
                leave[b] = gen[b] | now & keep.get(b, every)
    out = []
    for i, (name, b, _, _) in enumerate(facts):
        reach, found = entry[b] & of_name.get(name, 0), []
        while reach:
            low = reach & -reach
            found.append(places[low.bit_length() - 1])
            reach ^= low
        out.append((sights[i], found))
    return out


def block_facts(occ: DataFrame) -> DataFrame:
    """What a block knows of a name: ex, side, name, block, `place` (its last definition), `sight` (its first
    occurrence, if a use) and `uses` (place, and the definition before it in the block)."""
    eo = F.col("eo") if "eo" in occ.columns else evaluation_order()
    key = [*UNIT, "name", "block"]
    order = Window.partitionBy(*key).orderBy("_eo", "pos").rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("role") == "lhs", F.col("pos"))
    seen = occ.select(*key, eo.alias("_eo"), "pos", "role", place.alias("_def")).withColumn(
        "_local", F.last("_def", ignorenulls=True).over(order))
    at = F.struct("_eo", "pos")
    return seen.groupBy(*key).agg(
        F.max_by("_def", F.when(F.col("_def").isNotNull(), at)).alias("place"),
        F.min_by(F.when(F.col("role") == "rhs", F.col("pos")), at).alias("sight"),
        F.collect_list(F.when(F.col("role") == "rhs", F.struct("pos", F.col("_local").alias("local")))).alias("uses"),
    )


#: Occurrences of a text that are settled where the text was dealt, as so many times `MOST_FACTS`.
WHOLE_LOTS = 32


def _reached_in_lots(facts: list[tuple], edges: list[tuple], most: int) -> list[tuple[int | None, list[int]]]:
    """`_reached` of a text's facts by name, in groups of about `most`."""
    lots = -(-len(facts) // most)
    if lots <= 1:
        return _reached(facts, edges)
    found: list = [None] * len(facts)
    for lot in range(lots):
        at = [i for i, f in enumerate(facts) if f[0] % lots == lot]
        for i, x in zip(at, _reached([facts[i] for i in at], edges)):
            found[i] = x
    return found


def _settled(texts: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """Uses of whole texts (name, pos, block, eo, role of their occurrences), each with the places that reach it."""
    occ, edges = texts.column("occ"), texts.column("edges")
    names, at_pos, block, eo, role = occ.flatten().flatten()
    lengths = np.asarray(pc.fill_null(occ.value_lengths(), 0))
    text = np.repeat(np.arange(len(occ)), lengths)
    block, eo, pos = (np.asarray(pc.fill_null(c, NO_PLACE)) for c in (block, eo, at_pos))
    lhs, rhs = (np.asarray(pc.fill_null(pc.equal(role, r), False)) for r in ("lhs", "rhs"))
    name = coded(pa.chunked_array([names]))
    order = np.lexsort((pos, eo, name, block, text))
    text, name, block, pos, lhs, rhs = (c[order] for c in (text, name, block, pos, lhs, rhs))
    start = firsts(text, block, name)
    first, row = np.flatnonzero(start), np.arange(len(start))
    fact = np.cumsum(start) - 1
    latest = np.maximum.accumulate(np.where(lhs & (pos > NO_PLACE), row, -1))  # definitions up to a row
    last = latest[np.append(first[1:], len(row)) - 1] if len(row) else first
    place = np.where(last >= first, pos[last], NO_PLACE)
    before = np.concatenate([[-1], latest[:-1]])[: len(row)]
    local = np.where(before >= first[fact], pos[before], NO_PLACE)
    sight = np.where(rhs[first], pos[first], NO_PLACE)
    # each text's facts over its block graph
    known = [[None if p == NO_PLACE else p for p in c.tolist()] for c in (place, sight)]
    facts = list(zip(name[first].tolist(), block[first].tolist(), *known))
    graph = list(zip(*(c.to_pylist() for c in edges.flatten().flatten())))
    fact_ends = np.cumsum(np.bincount(text[first], minlength=len(occ))).tolist()
    edge_ends = np.cumsum(np.asarray(pc.fill_null(edges.value_lengths(), 0))).tolist()
    found: list[tuple[int | None, list[int]]] = []
    begin = edge_begin = 0
    for end, edge_end in zip(fact_ends, edge_ends):
        found += _reached_in_lots(facts[begin:end], graph[edge_begin:edge_end], most)
        begin, edge_begin = end, edge_end
    seen = np.array([NO_PLACE if s is None else s for s, _ in found], np.int64)
    counts = np.array([len(r) for _, r in found], np.int64)
    starts = np.cumsum(counts) - counts
    held = np.array([p for _, r in found for p in r], np.int64)
    # a use comes from the definition before it in its block, else from what reaches the block and the first sight
    use = np.flatnonzero(rhs)
    of = fact[use]
    is_local = local[use] > NO_PLACE
    times = np.where(is_local, 0, counts[of])
    other = ~is_local & (seen[of] > NO_PLACE) & (pos[use] > NO_PLACE) & (seen[of] != pos[use])
    whose = np.concatenate([np.repeat(np.arange(len(use)), times), np.flatnonzero(is_local), np.flatnonzero(other)])
    parent = np.concatenate([held[ranges(starts[of], times)], local[use[is_local]], seen[of[other]]])
    by = np.lexsort((parent, whose))
    by = by[firsts(whose[by], parent[by])]
    ends = np.concatenate([[0], np.cumsum(np.bincount(whose[by], minlength=len(use)))])
    taken, at = pa.array(order[use]), pa.array(text[use])
    parents = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(parent[by], pa.int64()))
    return pa.RecordBatch.from_arrays([*(texts.column(c).take(at) for c in UNIT), names.take(taken), at_pos.take(taken), parents],
                                      names=[*UNIT, "name", "pos", "parent_pos"])


def reaching_definitions(occ: DataFrame, blocks: DataFrame, most: int = MOST_FACTS) -> DataFrame:
    """Uses with every definition that reaches them over a block graph.

    `occ` has a `block` column, and may have `eo`, the order of evaluation; blocks are numbered in
    text order. A definition stops where the name is defined again. The first sight of a name defines
    it without a parent, if no block before it in the text, from which it can be reached, holds the
    name; such a definition adds to others that come back over a loop.

    Names do not depend on each other. Each block first settles its own uses and keeps one fact for
    each name. Facts of a text are settled by name in groups of about `most`, with bit sets of one group's
    definitions. Occurrences and block graph of a text meet where the text was dealt (plans that do not deal by
    `ex` or by text yet deal once). Texts of more than `WHOLE_LOTS` times `most`
    occurrences, if there are any, are settled by `spread_definitions`.
    """
    limit = WHOLE_LOTS * most
    eo = F.col("eo") if "eo" in occ.columns else evaluation_order()
    longer = occ.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > limit)
    if not longer.count():  # by all tasks at once, where a look for one row starts with one task
        large = None
    else:
        sized = occ.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*UNIT)))
        occ, large = (sized.where(F.col("_size") <= limit).drop("_size"), sized.where(F.col("_size") > limit).drop("_size"))
    number = [F.col(c).cast("bigint").alias(c) for c in ("pos", "block")]
    one = F.struct("name", *number, eo.cast("bigint").alias("eo"), "role")
    edge = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("block", "succ")])
    sent = occ.select(*UNIT, one.alias("one"), F.lit(None).cast("struct<block:bigint,succ:bigint>").alias("edge")).unionByName(
        blocks.where("ex is not null and side is not null").select(
            *UNIT, F.lit(None).cast("struct<name:string,pos:bigint,block:bigint,eo:bigint,role:string>").alias("one"), edge.alias("edge")))
    texts = sent.groupBy(*UNIT).agg(F.collect_list("one").alias("occ"), F.collect_list("edge").alias("edges")).where(F.size("occ") > 0)

    def run(batches):
        for batch in batches:
            size = np.asarray(pc.fill_null(batch.column("occ").value_lengths(), 0))
            cuts = np.flatnonzero(firsts((np.cumsum(size) - size) // TOGETHER)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(size)]):  # whole texts of about so many occurrences
                yield _settled(batch.slice(a, b - a), most)

    types = {f.name: f.dataType.simpleString() for f in occ.schema}
    found = _came_from(texts.mapInArrow(run, f"ex {types['ex']}, side {types['side']}, name string, pos bigint, parent_pos array<bigint>"))
    return found if large is None else found.unionByName(spread_definitions(large, blocks, most))


def _came_from(uses: DataFrame) -> DataFrame:
    return uses.select(
        *UNIT, "name", "pos", F.lit("comesFrom").alias("relation"),
        F.when(F.size("parent_pos") > 0, F.array("name")).otherwise(_no_names()).alias("parent_names"),
        "parent_pos",
    )


def spread_definitions(occ: DataFrame, blocks: DataFrame, most: int = MOST_FACTS) -> DataFrame:
    """`reaching_definitions` of long texts: facts of a text are dealt by name into groups of about `most`, so it
    is spread over tasks, each of which holds the text's block graph. A chain of blocks is one pass, not a job for each.
    """
    facts = block_facts(occ)
    large = facts.groupBy(*UNIT).agg(F.ceil(F.count(F.lit(1)) / most).alias("_lots")).where("_lots > 1")
    fact = F.struct("name", "block", "place", "sight", "uses")
    dealt = facts.join(large, UNIT, "left").withColumn(
        "_lot", F.pmod(F.xxhash64("name"), F.coalesce("_lots", F.lit(1))))
    groups = dealt.groupBy(*UNIT, "_lot").agg(F.collect_list(fact).alias("facts"))
    graphs = blocks.groupBy(*UNIT).agg(F.collect_list(F.struct("block", "succ")).alias("edges"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # one group at a time
                part = batch.slice(row, 1)
                held = part.column("facts")[0].values
                name, block, place, sight, uses = (held.field(c) for c in ("name", "block", "place", "sight", "uses"))
                graph = part.column("edges")[0].values
                pairs = [] if graph is None else list(zip(*(graph.field(c).to_pylist() for c in ("block", "succ"))))
                found = _reached(list(zip(name.to_pylist(), block.to_pylist(), place.to_pylist(), sight.to_pylist())), pairs)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("ex")[0].as_py()] * n, pa.int64()), pa.array([part.column("side")[0].as_py()] * n, pa.string()),
                     name, pa.array([s for s, _ in found], pa.int64()), pa.array([r for _, r in found], pa.list_(pa.int64())), uses],
                    names=[*UNIT, "name", "sight", "reach", "uses"],
                )

    settled = groups.join(graphs.hint("merge"), UNIT, "left").select(*UNIT, "facts", "edges").mapInArrow(
        run, "ex bigint, side string, name string, sight bigint, reach array<bigint>, uses array<struct<pos:bigint,local:bigint>>"
    )
    use = settled.where(F.size("uses") > 0).select(*UNIT, "name", "sight", "reach", F.inline("uses"))
    own = F.when(F.col("sight") != F.col("pos"), F.array("sight")).otherwise(_no_pos())
    parents = F.when(F.col("local").isNotNull(), F.array("local")).otherwise(F.array_sort(F.array_union("reach", own)))
    return _came_from(use.select(*UNIT, "name", "pos", parents.alias("parent_pos")))


def branch_edges(has_else: Column, before: Column, branches: Column, after: Column,
                 then_branch: Column, lang: Column) -> Column:
    """Block-graph edges around an if statement as array of (block, succ), per language.

    Without an else the state before always counts as a branch. With one, Python and Ruby drop
    it and the other languages keep it; JavaScript enters the else body after the then body.
    """
    keeps_before = ~lang.isin("python", "ruby", "javascript") | ~has_else

    def edge(a: Column, b: Column) -> Column:
        return F.struct(a.cast("bigint").alias("block"), b.cast("bigint").alias("succ"))

    entry = F.when(
        lang == "javascript",
        F.transform(branches, lambda b, i: edge(F.when(i == 0, before).otherwise(F.get(branches, i - 1)), b)),
    ).otherwise(F.transform(branches, lambda b: edge(before, b)))
    leave = F.when(
        (lang == "javascript") & has_else,
        F.concat(F.array(edge(before, after)), F.array(edge(F.element_at(branches, -1), after))),
    ).otherwise(F.transform(branches, lambda b: edge(b, after)))
    around = F.when(keeps_before, F.array(edge(before, after))).otherwise(
        F.array().cast("array<struct<block:bigint,succ:bigint>>")
    )
    return F.array_distinct(F.concat(entry, leave, around))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges of the same name, place and relation united, as after the second pass of a loop."""
    return edges.groupBy(*UNIT, "name", "pos", "relation").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("parent_names")))).alias("parent_names"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("parent_pos")))).alias("parent_pos"),
    )


def rule_table(spark: SparkSession, fill_gaps: bool = False) -> DataFrame:
    """lang, node_type, role for the supported languages."""
    rows = [
        (lang, kind, role)
        for lang, roles in STATEMENT_TYPES.items() for role, kinds in roles.items() for kind in kinds
    ]
    if fill_gaps:
        rows += [
            (lang, kind, role)
            for lang, roles in STATEMENT_GAPS.items() for role, kinds in roles.items() for kind in kinds
        ]
    return literal_table(spark, ["lang", "node_type", "role"], rows)


def classify_nodes(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes of a `lang` column with the role their type has in that language."""
    return nodes.join(
        rules.withColumnRenamed("node_type", "type"), ["lang", "type"], "left"
    )


def _by_place(edges: DataFrame) -> DataFrame:
    """One row per place with its edges, if it has parents or is some edge's parent.

    Edges go to their own place and a mark goes to each parent's place, so one grouping decides.
    """
    edge_type = "struct<name: string, relation: string, parent_names: array<string>, parent_pos: array<bigint>>"
    sent = F.expr(f"""concat(
        array(struct(pos, struct(name, relation, parent_names, parent_pos) as edge, size(parent_pos) > 0 as used)),
        transform(parent_pos, p -> struct(p as pos, cast(null as {edge_type}) as edge, true as used)))""")
    grouped = edges.select(*UNIT, sent.alias("sent")).select(*UNIT, F.inline("sent")).groupBy(*UNIT, "pos").agg(
        F.collect_list("edge").alias("edges"), F.max("used").alias("used")
    )
    return grouped.filter(F.col("used") & (F.size("edges") > 0)).drop("used")


def drop_isolated(edges: DataFrame) -> DataFrame:
    """Without nodes that have no parents and are nobody's parent."""
    return _by_place(edges).select(*UNIT, "pos", F.inline("edges")).select(*EDGE)


def _united(edges: Column) -> Column:
    """Edges of one place as one: names and places of the parents in place order."""
    def parents(e: Column) -> Column:
        return F.zip_with(
            e.getField("parent_pos"), e.getField("parent_names"),
            lambda p, n: F.struct(p.alias("p"), n.alias("n")),
        )

    first = F.array_min(
        F.transform(edges, lambda e: F.struct(e.getField("name").alias("name"), e.getField("relation").alias("relation")))
    )
    in_order = F.sort_array(F.flatten(F.transform(edges, parents)))
    several = F.struct(
        F.array_distinct(F.transform(in_order, lambda x: x.getField("n"))).alias("names"),
        F.array_distinct(F.transform(in_order, lambda x: x.getField("p"))).alias("places"),
    )
    only = F.get(edges, F.lit(0))
    single = F.struct(
        only.getField("parent_names").alias("names"), only.getField("parent_pos").alias("places")
    )
    return F.struct(first.alias("first"), F.when(F.size(edges) == 1, single).otherwise(several).alias("par"))


def _one_edge(by_place: DataFrame) -> DataFrame:
    return by_place.select(*UNIT, "pos", _united(F.col("edges")).alias("u")).select(
        *UNIT, F.col("u.first.name").alias("name"), "pos", F.col("u.first.relation").alias("relation"),
        F.col("u.par.names").alias("parent_names"), F.col("u.par.places").alias("parent_pos"),
    )


def merge_nodes(edges: DataFrame) -> DataFrame:
    """One edge per place; a place with several edges has their parents united."""
    payload = F.struct("name", "relation", "parent_names", "parent_pos")
    return _one_edge(edges.groupBy(*UNIT, "pos").agg(F.collect_list(payload).alias("edges")))


def connected_nodes(edges: DataFrame) -> DataFrame:
    """`drop_isolated` and `merge_nodes` in one grouping."""
    return _one_edge(_by_place(edges))


def normalize_names(edges: DataFrame) -> DataFrame:
    """Names as var_0, var_1, … by first mention, parents of an edge before its own name.

    Mentions are cut to the first per name before the shuffle and numbered within their example;
    numbers come back to the mentions by name, and mentions to their edges.
    """
    mentions = edges.select(
        *UNIT, "pos", "relation", F.posexplode(F.concat("parent_names", F.array("name"))).alias("i", "name")
    )
    first = mentions.groupBy(*UNIT, "name").agg(F.min(F.struct("pos", "i")).alias("first"))
    in_order = Window.partitionBy(*UNIT).orderBy("first", "name")
    names = first.select(
        *UNIT, "name", F.concat(F.lit("var_"), (F.row_number().over(in_order) - 1).cast("string")).alias("var")
    )
    numbered = mentions.join(names, [*UNIT, "name"]).groupBy(*UNIT, "pos", "relation").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "var"))), lambda x: x.getField("var")).alias("vars")
    )
    return numbered.select(
        *UNIT, "pos", F.element_at("vars", -1).alias("name"), "relation",
        F.slice("vars", F.lit(1), F.size("vars") - 1).alias("parent_names"),
    )


def normalize_within_edge(edges: DataFrame) -> DataFrame:
    """Names numbered inside each edge, parents first; a row expression."""
    def renamed(names: Column) -> Column:
        def var(n: Column) -> Column:
            return F.concat(F.lit("var_"), (F.array_position(names, n) - 1).cast("string"))

        return F.struct(
            var(F.col("name")).alias("name"), F.transform("parent_names", var).alias("parent_names")
        )

    distinct = F.array_distinct(F.concat("parent_names", F.array("name")))
    return edges.select(*UNIT, "pos", "relation", let(distinct, renamed).alias("r")).select(
        *UNIT, "pos", "r.name", "relation", "r.parent_names"
    )


def straight_flows(occ: DataFrame, dealt: bool = False) -> DataFrame:
    """`use_def` of uses and `assignments` together, in one pass over occurrences dealt by `ex`: all windows
    find their rows where they are, and each occurrence unrolls into its edges.

    `dealt`: the plan of `occ` deals by `ex` already, in tasks that grow in number with the input."""
    if not dealt:
        occ = occ.repartition("ex")
    name_order = Window.partitionBy(*UNIT, "name").orderBy("_eo", "pos")
    before = name_order.rowsBetween(Window.unboundedPreceding, -1)
    defines = (F.col("role") == "lhs") | (F.row_number().over(name_order) == 1)
    sources = F.collect_list(F.when(F.col("role") == "rhs", F.struct("name", "pos"))).over(Window.partitionBy(*UNIT, "stmt"))
    seen = (
        occ.select(*UNIT, "stmt", "name", "pos", "role").withColumn("_eo", evaluation_order())
        .withColumn("_def", F.when(defines, F.col("pos"))).withColumn("_par", F.last("_def", ignorenulls=True).over(before))
        .withColumn("_src", sources)
    )

    def edge(relation: str, names: Column, places: Column) -> Column:
        return F.struct(F.lit(relation).alias("relation"), names.alias("parent_names"), places.alias("parent_pos"))

    none = F.col("_par").isNull()
    used = F.array(edge("comesFrom", F.when(none, _no_names()).otherwise(F.array("name")), F.when(none, _no_pos()).otherwise(F.array("_par"))))
    made = F.transform("_src", lambda x: edge("computedFrom", F.array(x["name"]), F.array(x["pos"])))
    return seen.select(*UNIT, "name", "pos", F.inline(F.when(F.col("role") == "rhs", used).otherwise(made))).select(*EDGE)


def numbered_names(edges: DataFrame) -> DataFrame:
    """`normalize_names` by windows alone, for edges dealt by `ex` with one edge per place."""
    first = F.min(F.struct("pos", "i")).over(Window.partitionBy(*UNIT, "name"))
    mentions = edges.select(
        *UNIT, "pos", "relation", F.posexplode(F.concat("parent_names", F.array("name"))).alias("i", "name")
    ).withColumn("first", first)
    var = F.concat(F.lit("var_"), (F.dense_rank().over(Window.partitionBy(*UNIT).orderBy("first")) - 1).cast("string"))
    grouped = mentions.withColumn("var", var).groupBy(*UNIT, "pos", "relation").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "var"))), lambda x: x.getField("var")).alias("vars"))
    return grouped.select(
        *UNIT, "pos", F.element_at("vars", -1).alias("name"), "relation",
        F.slice("vars", F.lit(1), F.size("vars") - 1).alias("parent_names"),
    )


def _places_named(unit: np.ndarray, name: np.ndarray, pos: np.ndarray, stmt: np.ndarray, lhs: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, ...]:
    """`numbered_names(connected_nodes(straight_flows))` of whole examples as columns of numbers: per kept place
    its unit, position, relation and number of parents, and the numbers of all parents and then of all places."""
    order = np.lexsort((pos, stmt * 2 + lhs, name, unit))
    start = firsts(unit[order], name[order])
    row = np.arange(len(order))
    defined = np.maximum.accumulate(np.where((lhs[order] | start) & (pos[order] > NO_PLACE), row, -1))[:-1]
    parent = np.full(len(order), -1)
    parent[order[1:]] = np.where(defined >= np.maximum.accumulate(np.where(start, row, 0))[1:], order[defined], -1)
    used = np.flatnonzero(rhs)
    # each target of a statement meets each of its sources
    order = np.lexsort((~rhs, stmt, unit))
    new = firsts(unit[order], stmt[order])
    first, group = np.flatnonzero(new), np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    sources = np.bincount(group, rhs, len(first)).astype(np.int64)
    target = np.flatnonzero(~rhs)
    times = sources[group[target]]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    made = order[np.repeat(first[group[target]], times) + step]
    # edges as rows of the occurrence that they belong to, and of that which they come from
    at, source = np.concatenate([used, np.repeat(target, times)]), np.concatenate([parent[used], made])
    computed, has = np.arange(len(at)) >= len(used), source >= 0
    u, p = np.concatenate([unit[at], unit[source[has]]]), np.concatenate([pos[at], pos[source[has]]])
    order = np.lexsort((p, u))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(firsts(u[order], p[order])) - 1
    own, seen = place[: len(at)], np.zeros(len(order), bool)
    seen[place[len(at):]] = True
    seen[own[has]] = True
    kept = seen[own]
    at, source, computed, own, has = at[kept], source[kept], computed[kept], own[kept], has[kept]
    order = np.lexsort((computed, name[at], own))
    least = order[firsts(own[order])]  # one edge for each place, in place order
    # names of parents in the order of their positions, each once
    in_order = np.flatnonzero(has)
    in_order = in_order[np.lexsort((name[source[in_order]], pos[source[in_order]], own[in_order]))]
    where, called = own[in_order], name[source[in_order]]
    once = np.lexsort((np.arange(len(where)), called, where))
    once = np.sort(once[firsts(where[once], called[once])])
    where, called = where[once], called[once]
    count = np.bincount(where, minlength=len(seen))[own[least]] if len(seen) else np.zeros(0, np.int64)
    # mentions, parents before the place's own name, numbered by the first one of their name
    ends = np.cumsum(count + 1) - 1
    own_name = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, bool)
    own_name[ends] = True
    mention = np.empty(len(own_name), np.int64)
    mention[own_name], mention[~own_name] = name[at[least]], called
    text = np.repeat(unit[at[least]], count + 1)
    order = np.lexsort((np.arange(len(mention)), mention, text))
    new = firsts(text[order], mention[order])
    sight = np.empty(len(order), np.int64)
    sight[order] = order[new][np.cumsum(new) - 1]
    is_first = sight == np.arange(len(sight))
    before = np.cumsum(is_first) - 1
    number = before[sight] - before[np.flatnonzero(firsts(text))][np.cumsum(firsts(text)) - 1]
    return at[least], computed[least], count, number[~own_name], number[own_name]


def _named(table: pa.Table, new: np.ndarray) -> pa.RecordBatch:
    pos, stmt = (np.asarray(pc.fill_null(table[c].combine_chunks().cast(pa.int64()), NO_PLACE)) for c in ("pos", "stmt"))
    side = coded(table["side"])
    unit = (np.cumsum(new) - 1) * (side.max(initial=0) + 2) + side + 1
    lhs, rhs = (np.asarray(pc.fill_null(pc.equal(table["role"], r), False)) for r in ("lhs", "rhs"))
    at, computed, count, parents, own = _places_named(unit, coded(table["name"]), pos, stmt, lhs, rhs)
    names = pa.array([f"var_{i}" for i in range(int(own.max(initial=-1)) + 1)], pa.string())
    places = table.select(["ex", "side", "pos"]).take(pa.array(at))
    relation = pa.array(["comesFrom", "computedFrom"]).take(pa.array(computed.astype(np.int64)))
    held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), names.take(pa.array(parents)))
    columns = [*[c.combine_chunks() for c in places.columns], names.take(pa.array(own)), relation, held]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.int64(), *[c.type for c in columns[3:]]])],
                                      names=[*UNIT, "pos", "name", "relation", "parent_names"])


def straight_names(occ: DataFrame, dealt: bool = False) -> DataFrame:
    """`numbered_names(connected_nodes(straight_flows(occ)))`, column by column over whole examples.

    Occurrences are dealt by `ex` and sorted by it in their tasks; a task then holds about `TOGETHER` of them
    at a time, or one example. `dealt` as in `straight_flows`."""
    if not dealt:
        occ = occ.repartition("ex")
    rows = occ.select(*UNIT, "stmt", "name", "pos", "role").sortWithinPartitions("ex")

    def run(batches):
        for table, new in whole_examples(batches, TOGETHER):
            yield _named(table, new)

    return rows.mapInArrow(run, "ex bigint, side string, pos bigint, name string, relation string, parent_names array<string>")


def flow_match(pairs: DataFrame, edges: DataFrame, ref_side: str | list[str] = "ref") -> DataFrame:
    """model, idx, total, hit, as `dataflow_match` of `prepared_bags` gives them, without dealing rows anew.

    `edges` are dealt by `ex` (as `straight_flows` leaves them; others are dealt here). Places, names and
    equal edges are all grouped within an example, and an example ends as one row with the hits of each
    side, which is what meets the pairs.
    """
    return bag_match(pairs, edge_bags(numbered_names(connected_nodes(edges))), ref_side)


def straight_match(pairs: DataFrame, occ: DataFrame, ref_side: str | list[str] = "ref") -> DataFrame:
    """`flow_match` of `straight_flows(occ)`, for occurrences dealt by `ex`; only named edges are dealt anew."""
    return bag_match(pairs, edge_bags(straight_names(occ, dealt=True), deal=True), ref_side)


def bag_match(pairs: DataFrame, bags: DataFrame, ref_side: str | list[str] = "ref") -> DataFrame:
    """What `flow_match` makes of counted edges that are dealt by `ex`."""
    refs = [ref_side] if isinstance(ref_side, str) else list(ref_side)
    zero, alike = F.lit(0).cast("bigint"), Window.partitionBy("ex", "edge")
    wanted = [F.coalesce(F.max(F.when(F.col("side") == r, F.col("cnt"))).over(alike), zero) for r in refs]
    met = bags.select("ex", "side", "cnt", reduce(Column.__add__, [F.least(w, F.col("cnt")) for w in wanted]).alias("hit"))
    sums = met.groupBy("ex", "side").agg(F.sum("cnt").alias("cnt"), F.sum("hit").alias("hit"))
    is_ref = F.col("side").isin(refs)
    by_example = sums.groupBy("ex").agg(
        F.sum(F.when(is_ref, F.col("cnt"))).alias("total"),
        F.collect_list(F.when(~is_ref, F.struct(F.col("side").alias("model"), "hit"))).alias("hits"),
    ).select(F.col("ex").alias("idx"), "total", "hits")
    own = F.get(F.filter("hits", lambda h: h["model"] == F.col("model")), F.lit(0))["hit"]
    return pairs.select("model", "idx").join(by_example, "idx", "left").select(
        "model", "idx", F.coalesce("total", zero).alias("total"), F.coalesce(own, zero).alias("hit"))


def edge_bags(normalized: DataFrame, deal: bool = False) -> DataFrame:
    """Equal normalised edges counted per example and side; with `deal`, the edges are dealt by `ex` as texts."""
    edge = F.concat_ws("|", "name", "relation", F.array_join("parent_names", ","))
    edges = normalized.select(*UNIT, edge.alias("edge"))
    return (edges.repartition("ex") if deal else edges).groupBy(*UNIT, "edge").agg(F.count(F.lit(1)).alias("cnt"))


def prepared_bags(edges: DataFrame) -> DataFrame:
    """Edges as scoring sees them: connected, merged, renamed, counted.

    Renaming reads the merged edges twice, so they are written once in between.
    """
    return edge_bags(normalize_names(cut_lineage(connected_nodes(edges))))


def dataflow_match(pairs: DataFrame, bags: DataFrame, ref_side: str | list[str] = "ref") -> DataFrame:
    """model, idx, total, hit; a candidate edge is used once for each reference side."""
    is_ref = F.col("side").isin(ref_side)
    ref = bags.filter(is_ref).select(
        F.col("ex").alias("idx"), "edge", F.col("cnt").alias("want")
    )
    total = ref.groupBy("idx").agg(F.sum("want").alias("total"))
    held = bags.filter(~is_ref).select(
        F.col("ex").alias("idx"), F.col("side").alias("model"), "edge", "cnt"
    )
    hits = held.join(ref, ["idx", "edge"]).groupBy("model", "idx").agg(
        F.sum(F.least("want", "cnt")).alias("hit")
    )
    zero = F.lit(0).cast("bigint")
    return (
        pairs.select("model", "idx").join(total, "idx", "left").join(hits, ["model", "idx"], "left")
        .select("model", "idx", F.coalesce("total", zero).alias("total"),
                F.coalesce("hit", zero).alias("hit"))
    )
