"""Trees and data flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.arrays import joined, let, positions
from corpuslab.functions.text import snippet_lines
from corpuslab.operators import flow, structure, trees
from corpuslab.plans.registry import query
from corpuslab.plans.tables import TREE_PIECE
from corpuslab.sources.text import golden_blocks

EDGE_COLS = ["ex", "side", "name", "pos", "relation"]


def shown(edges: DataFrame) -> DataFrame:
    """Edges with their arrays as text."""
    return edges.select(
        *EDGE_COLS, joined(F.col("parent_names"), ",").alias("parent_names"),
        joined(F.col("parent_pos"), ",").alias("parent_pos"),
    )


@query("tree_subtrees", """
    select ex, side, node_id::bigint as node_id, depth::bigint as depth, sexp from subtrees""")
def tree_subtrees(t):
    return trees.subtrees(t.nodes)


@query("tree_leaf_tokens", """
    select ex, side, count(*)::bigint as leaves, string_agg(text,' ' order by node_id) as joined
    from nodes where text is not null group by all""")
def tree_leaf_tokens(t):
    leaves = trees.leaf_tokens(t.nodes)
    ordered = F.sort_array(F.collect_list(F.struct("tok", "text")))
    return leaves.groupBy("ex", "side").agg(
        F.count(F.lit(1)).alias("leaves"),
        F.array_join(F.transform(ordered, lambda x: x.getField("text")), " ").alias("joined"),
    )


@query("tree_variable_leaves", """
    select ex, side, type, count(*)::bigint as leaves from nodes where text is not null and type<>text group by all""")
def tree_variable_leaves(t):
    return trees.variable_leaves(t.nodes.filter(F.col("text").isNotNull())).groupBy("ex", "side", "type").agg(
        F.count(F.lit(1)).alias("leaves")
    )


@query("tree_span_text", """
    with l as (select idx as doc_id, line_no, line from side_lines where side='key1'),
    last as (select doc_id, max(line_no) as n from l group by doc_id)
    select l.doc_id, l.line_no as span_id, case when l.line_no=last.n then substr(l.line,3,6)
      else substr(l.line,3)||substr(m.line,1,5) end as text
    from l join last using (doc_id) left join l m on m.doc_id=l.doc_id and m.line_no=l.line_no+1""")
def tree_span_text(t):
    """A span from column 2 of every line to column 5 of the next one, or to column 8 of the last."""
    lines = t.documents.select("doc_id", F.posexplode(snippet_lines(F.col("text"))).alias("line_no", "line"))
    number = F.col("no").cast("int")
    spans = t.documents.select("doc_id", F.size(snippet_lines(F.col("text"))).alias("n")).select(
        "doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("no")
    )
    last = number == F.col("n") - 1
    spans = spans.select(
        "doc_id", F.col("no").cast("bigint").alias("span_id"), number.alias("start_row"), F.lit(2).alias("start_col"),
        F.when(last, number).otherwise(number + 1).alias("end_row"), F.when(last, 8).otherwise(5).alias("end_col"),
    )
    return trees.span_texts(spans, lines)


@query("flow_use_def", """
    select ex, side, name, pos, 'comesFrom' as relation, case when par is null then '' else name end as parent_names,
      coalesce(par::varchar,'') as parent_pos from uses where role='rhs'""")
def flow_use_def(t):
    return shown(flow.use_def(t.occ).filter(F.col("role") == "rhs"))


@query("flow_declarations", """
    select l.ex, l.side, l.name, l.pos, 'comesFrom' as relation, coalesce(r.name,'') as parent_names, coalesce(r.pos::varchar,'') as parent_pos
    from occ l left join occ r on r.ex=l.ex and r.side=l.side and r.stmt=l.stmt and r.role='rhs' where l.role='lhs'""")
def flow_declarations(t):
    return shown(flow.declarations(t.occ))


@query("flow_assignments", """
    select l.ex, l.side, l.name, l.pos, 'computedFrom' as relation, r.name as parent_names, r.pos::varchar as parent_pos
    from occ l join occ r on r.ex=l.ex and r.side=l.side and r.stmt=l.stmt and r.role='rhs' where l.role='lhs'""")
def flow_assignments(t):
    return shown(flow.assignments(t.occ))


@query("flow_assignments_grouped", """
    select l.ex, l.side, l.name, l.pos, 'computedFrom' as relation, string_agg(r.name,',' order by r.pos) as parent_names,
      string_agg(r.pos::varchar,',' order by r.pos) as parent_pos
    from occ l join occ r on r.ex=l.ex and r.side=l.side and r.stmt=l.stmt and r.role='rhs' where l.role='lhs' group by all""")
def flow_assignments_grouped(t):
    return shown(flow.assignments_grouped(t.occ))


@query("flow_assignments_tuple", """
    with o as (select *, pos%6 as k from occ),
    x as (select ex, side, stmt, name, pos, case when k<2 then 'lhs' else 'rhs' end as role, k%2 as item from o),
    n as (select ex, side, stmt, count(distinct case when role='lhs' then item end) as l, count(distinct case when role='rhs' then item end) as r from x group by all),
    y as (select x.*, case when l=r then item else 0 end as place from x join n using (ex, side, stmt))
    select a.ex, a.side, a.name, a.pos, 'computedFrom' as relation, string_agg(b.name,',' order by b.pos) as parent_names,
      string_agg(b.pos::varchar,',' order by b.pos) as parent_pos
    from y a join y b on b.ex=a.ex and b.side=a.side and b.stmt=a.stmt and b.place=a.place and b.role='rhs' where a.role='lhs' group by all""")
def flow_assignments_tuple(t):
    """Two targets a statement, each with the sources of its place in the tuple."""
    place = F.col("pos") % 6
    occ = t.occ.withColumns({"role": F.when(place < 2, "lhs").otherwise("rhs"), "item": place % 2})
    return shown(flow.assignments_grouped(occ, item="item"))


@query("flow_branch_edges", """
    with d as (select doc_id, doc_id%2=1 as has_else, case doc_id%7 when 0 then 'java' when 1 then 'python' when 2 then 'javascript'
      when 3 then 'ruby' when 4 then 'go' when 5 then 'php' else 'c_sharp' end as lang from documents),
    b as (select *, case when has_else then 3 else 2 end as after from d),
    e as (
      select doc_id, 0 as block, 1 as succ from b
      union select doc_id, case when lang='javascript' then 1 else 0 end, 2 from b where has_else
      union select doc_id, 1, after from b where not (lang='javascript' and has_else)
      union select doc_id, 2, after from b where has_else
      union select doc_id, 0, after from b where lang='javascript' and has_else
      union select doc_id, 0, after from b where not has_else or lang not in ('python','ruby','javascript'))
    select doc_id, block::bigint as block, succ::bigint as succ from e""")
def flow_branch_edges(t):
    """An if statement per document, with an else in every other one, in seven languages."""
    has_else = F.col("doc_id") % 2 == 1
    langs = F.array(*[F.lit(x) for x in ("java", "python", "javascript", "ruby", "go", "php", "c_sharp")])
    lang = F.get(langs, (F.col("doc_id") % 7).cast("int"))
    bodies = F.when(has_else, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    after = F.when(has_else, 3).otherwise(2)
    edges = flow.branch_edges(has_else, F.lit(0), bodies, after, F.lit(1), lang)
    return t.read("documents").select("doc_id", F.inline(edges))


@query("flow_increments", """
    select l.ex, l.side, l.name, l.pos, 'computedFrom' as relation, string_agg(r.name,',' order by r.pos) as parent_names,
      string_agg(r.pos::varchar,',' order by r.pos) as parent_pos
    from occ l join occ r on r.ex=l.ex and r.side=l.side and r.stmt=l.stmt group by all""")
def flow_increments(t):
    return shown(flow.increments(t.occ))


# Reaching definitions over the block graph: names seen before in the text, facts of blocks' ends
# (first sights add to what comes back over a loop), then what enters each block.
REACH_FACTS = """
    seen as (select distinct ex, side, name, block from o
      union select s.ex, s.side, s.name, b.succ from seen s join b on b.ex=s.ex and b.side=s.side and b.block=s.block and b.succ>b.block),
    before as (select distinct s.ex, s.side, s.name, b.succ as block from seen s join b on b.ex=s.ex and b.side=s.side and b.block=s.block and b.succ>b.block),
    f as (select *, row_number() over (partition by ex, side, block, name order by eo, pos) as k from o),
    sight as (select f.ex, f.side, f.name, f.block, f.pos from f
      anti join before p on p.ex=f.ex and p.side=f.side and p.name=f.name and p.block=f.block where f.k=1 and f.role='rhs'),
    u as (select *, last_value(case when role='lhs' then pos end ignore nulls) over (partition by ex, side, block, name order by eo, pos
        rows between unbounded preceding and 1 preceding) as loc from o),
    g as (select ex, side, block, name, arg_max(pos, eo*1000000+pos) as d from o where role='lhs' group by all),
    ends as (select ex, side, name, d, block from g
      union select s.ex, s.side, s.name, s.pos, s.block from sight s anti join g on g.ex=s.ex and g.side=s.side and g.block=s.block and g.name=s.name
      union select e.ex, e.side, e.name, e.d, b.succ from ends e join b on b.ex=e.ex and b.side=e.side and b.block=e.block
      anti join g on g.ex=e.ex and g.side=e.side and g.block=b.succ and g.name=e.name),
    ins as (select distinct e.ex, e.side, e.name, e.d, b.succ as block from ends e join b on b.ex=e.ex and b.side=e.side and b.block=e.block),
    found as (select u.ex, u.side, u.name, u.pos, i.d from u left join ins i on i.ex=u.ex and i.side=u.side and i.block=u.block and i.name=u.name
        where u.role='rhs' and u.loc is null
      union all select u.ex, u.side, u.name, u.pos, s.pos from u join sight s on s.ex=u.ex and s.side=u.side and s.block=u.block and s.name=u.name
        where u.role='rhs' and u.loc is null and u.pos<>s.pos
      union all select ex, side, name, pos, loc from u where role='rhs' and loc is not null)"""


def reach_sql(edges: str) -> str:
    return f"""
    with recursive o as (select *, stmt//2 as block, stmt*2+(case when role='lhs' then 1 else 0 end) as eo from occ),
    b as (select ex, side, block, succ from blocks where {edges}),{REACH_FACTS}
    select ex, side, name, pos, 'comesFrom' as relation, case when count(d)>0 then name else '' end as parent_names,
      coalesce(string_agg(distinct d::varchar,',' order by d::varchar),'') as parent_pos from found group by ex, side, name, pos"""



def _reaching(t, back_edges: bool) -> DataFrame:
    occ = t.occ.withColumn("block", F.floor(F.col("stmt") / 2))
    blocks = t.blocks
    if not back_edges:
        blocks = blocks.filter(F.col("succ") > F.col("block"))
    return flow.reaching_definitions(occ, blocks)


def _shown_by_text(edges: DataFrame) -> DataFrame:
    """Places in the order of their digits, which both systems sort alike."""
    places = F.sort_array(F.transform("parent_pos", lambda p: p.cast("string")))
    return edges.select(
        *EDGE_COLS, joined(F.col("parent_names"), ",").alias("parent_names"), F.array_join(places, ",").alias("parent_pos")
    )


@query("flow_branch_merge", reach_sql("succ>block"))
def flow_branch_merge(t):
    return _shown_by_text(_reaching(t, back_edges=False))


@query("flow_loop_merge", reach_sql("true"))
def flow_loop_merge(t):
    return _shown_by_text(flow.merge_edges(_reaching(t, back_edges=True)))


@query("flow_classify_nodes", """
    with r as (select * from (values ('toy','doc','sequence'),('toy','stmt','assignment'),('toy','args','rhs'),('toy','cap','leaf'),
      ('toy','word','leaf'),('toy','num','literal'),('toy','stop','punctuation')) v(lang,node_type,role))
    select n.side, n.type, r.role, count(*)::bigint as nodes from nodes n left join r on r.node_type=n.type group by all""")
def flow_classify_nodes(t):
    roles = flow.classify_nodes(t.nodes.withColumn("lang", F.lit("toy")), t.rules)
    return roles.groupBy("side", "type", "role").agg(F.count(F.lit(1)).alias("nodes"))


@query("flow_drop_isolated", """
    select side, relation, count(*)::bigint as edges, sum(len(parent_pos))::bigint as parents, sum(pos)::bigint as places
    from flows_kept group by all""")
def flow_drop_isolated(t):
    return flow.drop_isolated(t.flows).groupBy("side", "relation").agg(
        F.count(F.lit(1)).alias("edges"), F.sum(F.size("parent_pos")).cast("bigint").alias("parents"),
        F.sum("pos").alias("places"),
    )


_SHOWN = "array_to_string(parent_names,',') as parent_names, array_to_string(list_transform(parent_pos, lambda x: x::varchar),',') as parent_pos"


@query("flow_merge_nodes", f"select ex, side, name, pos, relation, {_SHOWN} from flows_merged")
def flow_merge_nodes(t):
    return shown(flow.merge_nodes(flow.drop_isolated(t.flows)))


@query("flow_normalize_names", "select ex, side, pos, name, relation, parents from flows_norm")
def flow_normalize_names(t):
    norm = flow.straight_names(t.occ, dealt=True)
    return norm.select("ex", "side", "pos", "name", "relation", joined(F.col("parent_names"), ",").alias("parents"))


@query("flow_normalize_edge", """
    with m as (select ex, side, pos, name, relation, parent_names, list_append(parent_names, name) as l from flows_merged),
    d as (select *, list_filter(l, lambda x, i: list_position(l, x)=i) as names from m)
    select ex, side, pos, 'var_'||(list_position(names, name)-1) as name, relation,
      array_to_string(list_transform(parent_names, lambda x: 'var_'||(list_position(names, x)-1)),',') as parents from d""")
def flow_normalize_edge(t):
    norm = flow.normalize_within_edge(flow.connected_nodes(t.flows))
    return norm.select("ex", "side", "pos", "name", "relation", joined(F.col("parent_names"), ",").alias("parents"))


# What statements make and what reaches each use, in the stand-in programs; equal edges merged.
_CODE_FLOWS = f"""
    with recursive o as (select ex, side, name, pos, block, eo, role from code_eo), b as (select * from code_blocks),{REACH_FACTS},
    reached as (select ex, side, name, pos, 'comesFrom' as relation, case when d is null then null else name end as pn, d as pp from found),
    every as (select * from code_made union all select * from reached)"""


@query("flow_from_nodes", f"""{_CODE_FLOWS}
    select ex, side, name, pos, relation, coalesce(string_agg(distinct pn,',' order by pn),'') as parent_names,
      coalesce(string_agg(distinct pp::varchar,',' order by pp::varchar),'') as parent_pos from every group by ex, side, name, pos, relation""")
def flow_from_nodes(t):
    """Trees to data flow: occurrences, block graphs, statement edges and reaching definitions."""
    return _shown_by_text(structure.whole_flows(t.code_nodes))


@query("flow_loop_edges", f"""{_CODE_FLOWS},
    back as (select distinct ex, side, name, pos, pp from reached where pp>pos)
    select code_occ.lang, back.ex, back.side, back.name, back.pos, back.pp as parent from back join code_occ
      on code_occ.ex=back.ex and code_occ.side=back.side and code_occ.pos=back.pos""")
def flow_loop_edges(t):
    """Uses that a loop's later definition reaches, in seven languages."""
    return structure.reached_uses(t.code_nodes).where("parent > pos")


@query("flow_control_roles", """
    with k as (select *, unnest([[0,1],[3,2],[6,3],[7,4],[8,5],[10,6],[13,7],[14,8]]) as e from (
      select ex, side, lang, is_for, u, max(k) as k from code_words group by all)),
    r as (select lang, is_for, case e[2] when 1 then 'declaration' when 2 then 'assignment' when 3 then case when lang in ('python','ruby') then null else 'increment' end
        when 4 then 'if' when 5 then 'assignment' when 6 then 'assignment'
        when 7 then case when is_for then 'for' else 'while' end
        else case when not is_for then 'assignment' when lang='go' then 'increment' end end as role from k where k>=e[1]
      union all select lang, true, case when lang='php' then 'assignment' else 'declaration' end from k where e[1]=13 and k>=13 and is_for and lang not in ('go','python','ruby')
      union all select lang, true, 'if' from k where e[1]=10 and k>=10 and lang in ('ruby','php'))
    select lang, role, count(*)::bigint as nodes from r where role is not null group by all""")
def flow_control_roles(t):
    """Statements of the stand-in trees by the language rules' roles."""
    rules = flow.rule_table(t.spark, fill_gaps=True)
    found = flow.classify_nodes(t.code_nodes.where("type <> 'else' or lang = 'ruby'"), rules).where("role is not null")
    return found.groupBy("lang", "role").agg(F.count(F.lit(1)).alias("nodes"))


@query("tree_golden_trees", """
    with w as (select doc_id, regexp_extract_all(lower(text),'[a-z]+') as a from documents),
    s as (select doc_id, i, a[i*5+1:i*5+5] as g from (select *, unnest(range(0, (len(a)+4)//5)) as i from w)),
    x as (select doc_id, i, '(stmt left: ('||g[1]||')'||case when len(g)>1 then ' right: (args '||array_to_string(list_transform(g[2:3], lambda t: '('||t||')'),' ')||')' else '' end
      ||case when len(g)>3 then ' '||array_to_string(list_transform(g[4:5], lambda t: '('||t||')'),' ') else '' end||')' as sexp, len(g) as n from s)
    select w.doc_id, (1+coalesce(count(i),0)+coalesce(sum(n+case when n>1 then 1 else 0 end),0))::bigint as nodes,
      md5('(program'||coalesce(' '||string_agg(sexp,' ' order by i),'')||')') as sexp_md5
    from w left join x using (doc_id) group by w.doc_id""")
def tree_golden_trees(t):
    """Golden files of the documents' words, cut into blocks, read as node tables and written again."""
    def statement(g):
        rest = F.array_join(F.transform(F.slice(g, 4, 2), lambda w: F.concat(F.lit("\n    ("), w, F.lit(")"))), "")
        args = F.array_join(F.transform(F.slice(g, 2, 2), lambda w: F.concat(F.lit("("), w, F.lit(")"))), " ")
        right = F.when(F.size(g) > 1, F.concat(F.lit("\n    right: (args "), args, F.lit(")"))).otherwise("")
        return F.concat(F.lit("\n  (stmt\n    left: ("), F.get(g, F.lit(0)), F.lit(")"), right, rest, F.lit(")"))

    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    tree = let(words, lambda w: F.array_join(F.transform(positions(F.ceil(F.size(w) / 5).cast("int")), lambda i: statement(F.slice(w, i * 5 + 1, 5))), ""))
    bar = F.lit("=" * 6)
    content = F.concat(bar, F.lit("\n"), "source", F.lit("\n"), bar, F.lit("\n\ncode\n\n---\n\n(program"), tree, F.lit(")\n"))
    texts = t.dealt("documents", t.read("documents").select("doc_id", "text", "source"), "doc_id", TREE_PIECE)
    blocks = golden_blocks(texts.select("doc_id", content.alias("value")))
    # texts are kept where they were dealt, and their nodes, many times as large, made again for each use
    kept = flow.cut_lineage(blocks.select(F.col("doc_id").alias("ex"), F.col("name").alias("side"), "tree"))
    nodes = trees.parsed(kept, ["ex", "side"], dealt=True)
    whole = trees.subtrees(nodes, fields=True, dealt=True).where("depth = 1").select("ex", F.md5("sexp").alias("sexp_md5"))
    sizes = nodes.groupBy("ex").agg(F.count(F.lit(1)).alias("nodes"))
    return sizes.join(whole, "ex").select(F.col("ex").alias("doc_id"), "nodes", "sexp_md5")
