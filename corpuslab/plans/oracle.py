"""The derived tables once more, as SQL common table expressions for the checks."""

from __future__ import annotations

import re

from corpuslab.plans import code_trees

# name -> SQL over the given tables and other names of this dictionary
TABLES: dict[str, str] = {
    "segments": r"""
        select conv_id*1048576+turn as idx, role, conv_id,
          list_filter(regexp_split_to_array(text,'\s+'), lambda x: x<>'') as a from conversations""",
    "words": "select idx, generate_subscripts(a,1)-1 as pos, unnest(a) as w from segments",
    "refs": "select idx, array_to_string(a,' ') as ref from segments",
    "hyps": """
        select 'drop5' as model, idx, pos, w from words where (pos*7+idx) % 5 <> 0
        union all select 'drop11', idx, pos, w from words where (pos*7+idx) % 11 <> 0
        union all select 'drop97', idx, pos, w from words where (pos*7+idx) % 97 <> 0
        union all select 'sub9', idx, pos, case when pos % 9 = 0 then 'x'||w else w end from words
        union all select 'dup13', idx, pos, case when pos % 13 = 0 then w||' '||w else w end from words""",
    "preds": """
        select m.model, r.idx, r.ref, coalesce(h.hyp,'') as hyp
        from refs r cross join (select distinct model from hyps) m
        left join (select model, idx, string_agg(w,' ' order by pos) as hyp from hyps group by model, idx) h
          on h.model=m.model and h.idx=r.idx""",
    "multiref": """
        select p.idx, 0 as ref_no, p.ref, p.hyp from preds p where p.model='drop11'
        union all select p.idx, 1, s.hyp, p.hyp from preds p
          join preds s on s.idx=p.idx and s.model='sub9' where p.model='drop11'
        union all select p.idx, 2, f.t, p.hyp from preds p join (
          select idx, string_agg(w,' ' order by pos) t
          from (select *, count(*) over (partition by idx) n from words)
          where pos < greatest(1, n // 2) group by idx) f on f.idx=p.idx where p.model='drop11'""",
    # token lists of every prediction and its reference, one row each
    "seg_tok": """
        select model, idx, list_filter(string_split(ref,' '), lambda x: x<>'') as r,
          list_filter(string_split(hyp,' '), lambda x: x<>'') as h, trim(ref)=trim(hyp) as exact from preds""",
    "hyp_grams": """
        select model, idx, n, array_to_string(h[i:i+n-1],chr(31)) as gram, count(*) as ch from (
          select model, idx, h, n, unnest(range(1, len(h)-n+2)) as i
          from seg_tok cross join (select unnest([1,2,3,4,5]) as n)) group by all""",
    "ref_grams": """
        select idx, n, array_to_string(a[i:i+n-1],chr(31)) as gram, count(*) as cr from (
          select idx, a, n, unnest(range(1, len(a)-n+2)) as i
          from segments cross join (select unnest([1,2,3,4,5]) as n)) group by all""",
    "overlap": """
        select h.model, h.idx, h.n, sum(least(ch, coalesce(cr,0)))::bigint as m, sum(ch)::bigint as p
        from hyp_grams h left join ref_grams r on r.idx=h.idx and r.n=h.n and r.gram=h.gram group by all""",
    "seg_orders": """
        select s.model, s.idx, n.n, coalesce(o.m,0) as m, coalesce(o.p,0) as p, len(s.h) as hl, len(s.r) as rl
        from seg_tok s cross join (select unnest([1,2,3,4,5]) as n) n
        left join overlap o on o.model=s.model and o.idx=s.idx and o.n=n.n""",
    "lens": """
        select model, sum(len(h))::double as hl, sum(len(r))::double as rl from seg_tok group by model""",
    "bleu_g": """
        select model, exp(avg(ln((m+1)/(p+1)))) * min(case when hl>rl then 1.0 else exp(1-rl/hl) end) as bleu
        from (select model, n, sum(m)::double as m, sum(p)::double as p from seg_orders where n<=4 group by all)
        join lens using (model) group by model""",
    "seg_bleu_g": """
        select model, idx, exp(avg(ln((m+1.0)/(p+1.0)))) *
          min(case when hl=0 then 0.0 when hl>rl then 1.0 else exp(1-rl::double/hl) end) as bleu, min(hl) as hl, min(rl) as rl
        from seg_orders where n<=4 group by all""",
    "bleu_n": """
        select model, exp(sum(0.25*ln(case when m=0 then 0.1/p else m/p end))) *
          min(case when hl>rl then 1.0 else exp(1-rl/hl) end) as bleu
        from (select model, n, sum(m)::double as m, sum(greatest(1,p))::double as p
              from seg_orders where n<=4 group by all)
        join lens using (model) group by model""",
    "seg_bleu_n": """
        select model, idx, case when max(case when n=1 then m end)=0 then 0.0 else
          exp(sum(0.25*ln(case when m=0 then 0.1/greatest(1,p) else m::double/greatest(1,p) end))) *
          min(case when hl>rl then 1.0 when hl=0 then 0.0 else exp(1-rl::double/hl) end) end as bleu
        from seg_orders where n<=4 group by all""",
    "keywords": "select unnest(['the','of','and','in','le','der','que']) as word",
    "recall_terms": """
        select s.model, s.idx, 1 as n, coalesce(o.num,0) as num, greatest(1, t.den) as den, len(s.h) as hl, len(s.r) as rl
        from seg_tok s join (
          select idx, sum(case when gram in (select word from keywords) then cr else 0.2*cr end)::double as den
          from ref_grams where n=1 group by idx) t on t.idx=s.idx
        left join (select h.model, h.idx,
            sum(least(ch,cr)*case when h.gram in (select word from keywords) then 1.0 else 0.2 end)::double as num
          from hyp_grams h join ref_grams r on r.idx=h.idx and r.n=h.n and r.gram=h.gram where h.n=1 group by all) o
          on o.model=s.model and o.idx=s.idx
        union all select model, idx, n, m, greatest(1, rl-n+1), hl, rl from seg_orders where n between 2 and 4""",
    "recall": """
        select model, exp(sum(0.25*ln(case when num=0 then 0.1/den else num/den end))) *
          min(case when hl>2*segs then 1.0 else exp(1-2*segs/hl) end) as weighted_recall,
          exp(sum(0.25*ln(case when num=0 then 0.1/den else num/den end))) *
          min(case when hl>rl then 1.0 else exp(1-rl/hl) end) as strict_recall,
          exp(sum(0.25*ln((num+1)/(den+1)))) *
          min(case when hl>2*segs then 1.0 else exp(1-2*segs/hl) end) as recall_m2
        from (select model, n, sum(num)::double as num, sum(den)::double as den, count(*)::double as segs,
              sum(hl)::double as hl, sum(rl)::double as rl from recall_terms group by all) group by model""",
    "seg_recall": """
        select model, idx, case when max(case when n=1 then num end)=0 then 0.0 else
          exp(sum(0.25*ln(case when num=0 then 0.1/den else num/den end))) *
          min(case when hl>2 then 1.0 when hl=0 then 0.0 else exp(1-2.0/hl) end) end as weighted_recall
        from recall_terms group by all""",
    "pairs": """
        select case when doc_id%10<8 then 'train' when doc_id%10=8 then 'valid' else 'test' end as split,
          doc_id as idx, text as key1, replace(replace(text,' th',' d'),'ou','u') as key2 from documents""",
    "side_lines": """
        select split, idx, side, generate_subscripts(l,1)-1 as line_no, trim(unnest(l)) as line from (
          select split, idx, 'key1' as side, string_split(trim(key1, ' '||chr(10)),chr(10)) as l from pairs
          union all select split, idx, 'key2', string_split(trim(key2, ' '||chr(10)),chr(10)) from pairs)""",
    "line_toks": r"""
        select split, idx, side, line_no,
          regexp_extract_all('▁'||replace(line,' ','▁'),'[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]') as t
        from side_lines where line<>''""",
    "toks": """
        select split, idx, side, line_no, generate_subscripts(t,1)-1 as pos, unnest(t) as token from line_toks""",
    "specials": """
        select id, token from (values (0,'<pad>'),(1,'<unk>'),(2,'<cs>'),(3,'</cs>'),(4,'<CS>'),(5,'</CS>'),
          (6,'<java>'),(7,'</java>'),(8,'<JAVA>'),(9,'</JAVA>'),(10,'<cl>')) v(id,token)""",
    "vocab": """
        select id::bigint as id, token from specials
        union all select 10+row_number() over (order by c desc, token), token from (
          select token, count(*) c from toks where split='train' group by token order by c desc, token limit 3989)""",
    "user_events": "select *, row_number() over (partition by user_id order by ts, event_id) as rn from events",
    "attn": """
        select ex, step, src, src//5 as line_no, ((event_id*(step+3)) % 17)/4.0 as score, mask,
          event_id % 50 as ext_id, (ex*3+step)%10/10.0 as p_gen, (ex+step)%50 as y_true,
          case when (ex+step)%6=0 then 1 else 0 end as y_mask
        from (select user_id as ex, event_id, case when event_type='error' then 1 else 0 end as mask, rn-1 as src
              from user_events) e cross join (select unnest([0,1,2,3]) as step)""",
    "weights": """
        select *, exp(z-max(z) over w)/sum(exp(z-m)) over w as weight from (
          select *, max(z) over (partition by ex, step) as m from (
            select *, score + mask*(-1e10) as z from attn)) window w as (partition by ex, step)""",
    "coverage": """
        select *, coalesce(sum(weight) over (partition by ex, src order by step
          rows between unbounded preceding and 1 preceding), 0) as coverage from weights""",
    "dist": """
        select ex, step, id, w*1.0/sum(w) over (partition by ex, step) as p from (
          select ex, step, id, 1+(id*(step+1)+ex)%7 as w from (select distinct ex, step from attn)
          cross join (select unnest(range(30)) as id))""",
    "mixture": """
        select ex, step, id, sum(p) as p from (
          select d.ex, d.step, d.id, d.p*a.p_gen as p from dist d
          join (select distinct ex, step, p_gen from attn) a on a.ex=d.ex and a.step=d.step
          union all select ex, step, ext_id, weight*(1-p_gen)*(1-mask) from weights) group by all""",
    "runlog": """
        select user_id as run, rn as epoch, value as train_loss, (floor(value) % 50)::double as valid_loss
        from user_events""",
    "steplog": "select user_id as run, (rn-1)//10 as epoch, (rn-1)%10 as step, value as loss from user_events",
    "sidewords": """
        select ex, side, generate_subscripts(t,1)-1 as pos, unnest(t) as w from (
          select idx as ex, 'ref' as side, a as t from segments
          union all select idx, model, h from seg_tok)""",
    "typed": r"""
        select *, pos//6 as stmt, pos%6 as k, case when regexp_matches(w,'^[0-9]+$') then 'num'
          when regexp_matches(w,'[.,;]') then 'stop' when regexp_matches(w,'^\p{Lu}') then 'cap'
          else 'word' end as ty from sidewords""",
    "nodes": """
        select distinct ex, side, 0 as node_id, cast(null as bigint) as parent_id, 0 as ord, 'doc' as type,
          true as is_named, cast(null as varchar) as text from typed
        union all select distinct ex, side, stmt*100+1, 0, stmt, 'stmt', true, null from typed
        union all select distinct ex, side, stmt*100+2, stmt*100+1, 3, 'args', true, null from typed where k>=3
        union all select ex, side, stmt*100+10+k, case when k>=3 then stmt*100+2 else stmt*100+1 end, k, ty,
          ty<>'stop', w from typed""",
    "leaf_sexp": """
        select ex, side, parent_id, string_agg('('||type||')', ' ' order by ord) as body
        from nodes where text is not null and is_named group by all""",
    "args_sexp": """
        select n.ex, n.side, n.node_id, n.parent_id, n.ord,
          '(args'||coalesce(' '||l.body,'')||')' as sexp from nodes n
        left join leaf_sexp l on l.ex=n.ex and l.side=n.side and l.parent_id=n.node_id where n.type='args'""",
    "stmt_sexp": """
        select n.ex, n.side, n.node_id, n.ord,
          '(stmt'||coalesce(' '||l.body,'')||coalesce(' '||a.sexp,'')||')' as sexp from nodes n
        left join leaf_sexp l on l.ex=n.ex and l.side=n.side and l.parent_id=n.node_id
        left join args_sexp a on a.ex=n.ex and a.side=n.side and a.parent_id=n.node_id where n.type='stmt'""",
    "subtrees": """
        select ex, side, node_id, sexp, 3 as depth from args_sexp
        union all select ex, side, node_id, sexp, 2 from stmt_sexp
        union all select ex, side, 0, '(doc '||string_agg(sexp,' ' order by ord)||')', 1 from stmt_sexp group by all""",
    "syntax": """
        select c.model, c.idx, t.total, coalesce(m.hit,0) as hit from (select model, idx from preds) c
        join (select ex, count(*) as total from subtrees where side='ref' group by ex) t on t.ex=c.idx
        left join (select d.side as model, r.ex, sum(r.cnt) as hit from
            (select ex, sexp, count(*) as cnt from subtrees where side='ref' group by all) r
          join (select distinct ex, side, sexp from subtrees where side<>'ref') d on d.ex=r.ex and d.sexp=r.sexp
          group by all) m on m.model=c.model and m.ex=c.idx""",
    "occ": """
        select ex, side, pos//6 as stmt, pos, lower(substr(w,1,2)) as name,
          case when pos%6=0 then 'lhs' else 'rhs' end as role, pos%6=0 as is_def from sidewords""",
    "blocks": """
        with b as (select distinct ex, side, stmt//2 as block from occ)
        select a.ex, a.side, a.block, c.block as succ from b a join b c on c.ex=a.ex and c.side=a.side
          and (c.block=a.block+1 or (a.block%3=0 and c.block=a.block+2) or (a.block%4=3 and c.block=a.block-1))""",
    "uses": """
        select *, last_value(case when defines then pos end ignore nulls) over (partition by ex, side, name
            order by eo, pos rows between unbounded preceding and 1 preceding) as par from (
          select *, role='lhs' or row_number() over (partition by ex, side, name order by eo, pos)=1 as defines from (
            select *, stmt*2+(case when role='lhs' then 1 else 0 end) as eo from occ))""",
    "flows": """
        select ex, side, name, pos, 'comesFrom' as relation,
          case when par is null then [] else [name] end as parent_names,
          case when par is null then [] else [par] end as parent_pos from uses where role='rhs'
        union all select l.ex, l.side, l.name, l.pos, 'computedFrom', [r.name], [r.pos]
        from occ l join occ r on r.ex=l.ex and r.side=l.side and r.stmt=l.stmt and r.role='rhs'
        where l.role='lhs'""",
    "flows_kept": """
        with used as (select ex, side, pos from flows where len(parent_pos)>0
          union select ex, side, unnest(parent_pos) from flows)
        select f.* from flows f semi join used u on u.ex=f.ex and u.side=f.side and u.pos=f.pos""",
    "flows_long": """
        select ex, side, name, pos, relation, unnest(parent_names) as pn, unnest(parent_pos) as pp from flows_kept""",
    "flows_merged": """
        select k.ex, k.side, k.pos, k.name, k.relation, coalesce(p.parent_names, []) as parent_names,
          coalesce(q.parent_pos, []) as parent_pos
        from (select ex, side, pos, min(name) as name, min(relation) as relation from flows_kept group by all) k
        left join (select ex, side, pos, list(pn order by mp, pn) as parent_names from (
            select ex, side, pos, pn, min(pp) as mp from flows_long group by all) group by all) p
          on p.ex=k.ex and p.side=k.side and p.pos=k.pos
        left join (select ex, side, pos, list(pp order by pp) as parent_pos from (
            select distinct ex, side, pos, pp from flows_long) group by all) q
          on q.ex=k.ex and q.side=k.side and q.pos=k.pos""",
    "mentions": """
        select ex, side, pos, generate_subscripts(l,1) as i, unnest(l) as name from (
          select ex, side, pos, list_append(parent_names, name) as l from flows_merged)""",
    "var_ids": """
        select ex, side, name, row_number() over (partition by ex, side order by pos, i)-1 as var from (
          select *, row_number() over (partition by ex, side, name order by pos, i) as rn from mentions) where rn=1""",
    "flows_norm": """
        select m.ex, m.side, m.pos, 'var_'||n.var as name, m.relation, coalesce(p.parents,'') as parents
        from flows_merged m join var_ids n on n.ex=m.ex and n.side=m.side and n.name=m.name
        left join (select x.ex, x.side, x.pos, string_agg('var_'||v.var, ',' order by x.i) as parents from (
            select ex, side, pos, generate_subscripts(parent_names,1) as i, unnest(parent_names) as pn from flows_merged) x
          join var_ids v on v.ex=x.ex and v.side=x.side and v.name=x.pn group by all) p
          on p.ex=m.ex and p.side=m.side and p.pos=m.pos""",
    "flow_bag": """
        select ex, side, name||'|'||relation||'|'||parents as edge, count(*) as cnt from flows_norm group by all""",
    "dataflow": """
        select c.model, c.idx, coalesce(t.total,0) as total, coalesce(m.hit,0) as hit from (select model, idx from preds) c
        left join (select ex, sum(cnt) as total from flow_bag where side='ref' group by ex) t on t.ex=c.idx
        left join (select b.side as model, r.ex, sum(least(r.cnt,b.cnt)) as hit from flow_bag r
          join flow_bag b on b.ex=r.ex and b.edge=r.edge and b.side<>'ref' where r.side='ref' group by all) m
          on m.model=c.model and m.ex=c.idx""",
    "code_bleu": """
        select b.model, 0.25*b.bleu+0.25*w.weighted_recall+0.25*s.syntax+0.25*d.flow as code_bleu from bleu_n b
        join recall w using (model)
        join (select model, sum(hit)::double/sum(total) as syntax from syntax group by model) s using (model)
        join (select model, sum(hit)::double/sum(total) as flow from dataflow group by model) d using (model)""",
    "seg_code_bleu": """
        select b.model, b.idx, 0.25*b.bleu+0.25*w.weighted_recall+0.25*s.hit/s.total+
          0.25*case when d.total=0 then 0 else d.hit::double/d.total end as code_bleu from seg_bleu_n b
        join seg_recall w using (model, idx) join syntax s using (model, idx) join dataflow d using (model, idx)""",
}

TABLES |= code_trees.SQL

_NAME = re.compile(r"\b(?:from|join)\s+([a-z_]+)")


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in TABLES]


def with_tables(sql: str) -> str:
    """Prefix a query with the derived tables it names, in dependency order."""
    order: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in order or name in path:
            return
        for other in _needs(TABLES[name]):
            if other != name:
                visit(other, (*path, name))
        order.append(name)

    for name in _needs(sql):
        visit(name, ())
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} as materialized ({TABLES[n].strip()})" for n in order)
    body = sql.strip()
    for opening in ("with recursive ", "with "):
        if body.startswith(opening):
            return f"{opening}{ctes},\n{body[len(opening):]}"
    return f"with {ctes}\n{body}"
