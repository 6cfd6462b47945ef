"""Stand-in syntax trees in seven languages, and the SQL that says what flows in them.

The given tables hold no code, so each text is read as a program: every sixteen words are a declaration (3
words), an assignment (3), an increment (1), an if with a first body and an else (6) and a loop (3), as
far as the words go. A node's id is 64 times the number of the sixteen, plus its place in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.tables import literal_table

LANGS = ("java", "python", "javascript", "ruby", "go", "php", "c_sharp")
#: Types of declarations, assignments, increments, ifs and while loops.
TYPES = {
    "java": ("variable_declarator", "assignment_expression", "update_expression", "if_statement", "while_statement"),
    "python": ("default_parameter", "assignment", "expression_statement", "if_statement", "while_statement"),
    "javascript": ("variable_declarator", "augmented_assignment_expression", "update_expression", "if_statement", "while_statement"),
    "ruby": ("keyword_parameter", "assignment", "call", "if", "until"),
    "go": ("var_spec", "assignment_statement", "inc_statement", "if_statement", None),
    "php": ("simple_parameter", "assignment_expression", "update_expression", "if_statement", "while_statement"),
    "c_sharp": ("variable_declarator", "assignment_expression", "postfix_unary_expression", "if_statement", "while_statement"),
}
WRAPPED = {"java": "local_variable_declaration", "c_sharp": "local_variable_declaration", "javascript": "variable_declaration"}


def _loop(lang: str, is_for: bool) -> list[tuple]:
    declaration, assignment, increment, _, while_type = TYPES[lang]
    if not is_for and lang != "go":
        return [
            (13, 25, 0, 5, while_type, None, False), (13, 26, 25, 1, "condition", "condition", False), (13, 27, 26, 0, "identifier", None, True),
            (14, 28, 25, 2, "block", "body", False), (14, 29, 28, 0, assignment, None, False), (14, 30, 29, 0, "identifier", "left", True),
            (15, 31, 29, 2, "identifier", "right", True),
        ]
    top = (13, 25, 0, 5, {"ruby": "for"}.get(lang, "for_statement"), None, False)
    if lang in WRAPPED:
        value = None if lang == "c_sharp" else "value"
        return [
            top, (13, 26, 25, 1, WRAPPED[lang], None, False), (13, 27, 26, 0, declaration, None, False),
            (13, 28, 27, 0, "identifier", "name" if value else None, True), (14, 29, 27, 1, "identifier", value, True),
            (15, 30, 25, 3, "block", "body", False), (15, 31, 30, 0, "identifier", None, True),
        ]
    if lang == "php":
        return [
            top, (13, 26, 25, 1, assignment, None, False), (13, 28, 26, 0, "identifier", "left", True), (14, 29, 26, 2, "identifier", "right", True),
            (15, 30, 25, 3, "block", "body", False), (15, 31, 30, 0, "identifier", None, True),
        ]
    if lang == "go":
        return [
            top, (13, 26, 25, 1, "for_clause", None, False), (13, 28, 26, 0, "identifier", "initializer", True),
            (14, 29, 26, 2, increment, "update", False), (14, 30, 29, 0, "identifier", None, True), (15, 31, 25, 2, "identifier", "body", True),
        ]
    return [
        top, (13, 28, 25, 1, "identifier", "left" if lang == "python" else "pattern", True),
        (14, 29, 25, 3, "identifier", "right" if lang == "python" else "value", True),
        (15, 30, 25, 5, "block", "body", False), (15, 31, 30, 0, "identifier", None, True),
    ]


def template(lang: str, is_for: bool) -> list[tuple]:
    """(word, place, parent's place or 0 for the root, ord, type, field, whether a leaf) of the nodes of sixteen words,
    each with the word that brings it."""
    declaration, assignment, increment, if_type, _ = TYPES[lang]
    labels = {"c_sharp": (None, None), "php": ("name", "default_value")}.get(lang, ("name", "value"))
    rows = [
        (0, 1, 0, 1, declaration, None, False), (0, 2, 1, 0, "identifier", labels[0], True), (1, 3, 1, 1, "binary_expression", labels[1], False),
        (1, 4, 3, 0, "identifier", None, True), (2, 5, 3, 1, "identifier", None, True),
        (3, 6, 0, 2, assignment, None, False), (3, 7, 6, 0, "identifier", "left", True), (4, 8, 6, 2, "argument_list", "right", False),
        (4, 9, 8, 0, "identifier", None, True), (5, 10, 8, 1, "identifier", None, True),
        (6, 11, 0, 3, increment, None, False), (6, 12, 11, 0, "identifier", None, True),
        (7, 13, 0, 4, if_type, None, False), (7, 14, 13, 1, "condition", "condition", False), (7, 15, 14, 0, "identifier", None, True),
        (8, 16, 13, 2, "block", "consequence", False), (8, 17, 16, 0, assignment, None, False), (8, 18, 17, 0, "identifier", "left", True),
        (9, 19, 17, 2, "identifier", "right", True),
    ]
    if lang in ("java", "c_sharp", "go"):
        rows += [(10, 20, 13, 3, "else", None, None), (10, 21, 13, 4, "block", "alternative", False)]
    else:
        rows += [(10, 21, 13, 4, "else" if lang == "ruby" else "else_clause", "alternative", False)]
    rows += [(10, 22, 21, 0, assignment, None, False), (10, 23, 22, 0, "identifier", "left", True), (11, 24, 22, 2, "identifier", "right", True)]
    shifted = {p: p + 1 for p in range(25, 32)}  # the else body has one more leaf
    rows += [(12, 25, 21, 1, "identifier", None, True)]
    return rows + [(w, shifted[p], shifted.get(q, q), o, t, f, leaf) for w, p, q, o, t, f, leaf in _loop(lang, is_for)]


def code_nodes(sidewords: DataFrame) -> DataFrame:
    """The node table of texts given as ex, side, pos, w."""
    spark = sidewords.sparkSession
    rows = [(lang, is_for, *r) for lang in LANGS for is_for in (False, True) for r in template(lang, is_for)]
    plan = literal_table(spark, ["lang", "is_for", "word", "place", "parent", "ord0", "type", "field", "leaf"], [
        (a, b, w, p, q, o, t, f or "", "token" if leaf is None else "leaf" if leaf else "inner") for a, b, w, p, q, o, t, f, leaf in rows])
    unit = F.floor(F.col("pos") / 16)
    words = sidewords.where("w <> ''").select(
        "ex", "side", "w", unit.alias("unit"), (F.col("pos") % 16).cast("int").alias("word"), (unit % 2 == 1).alias("is_for"),
        F.get(F.array(*[F.lit(x) for x in LANGS]), F.pmod("ex", F.lit(7)).cast("int")).alias("lang"))
    base = F.col("unit") * 64
    inner = words.join(plan, ["lang", "is_for", "word"]).select(
        "ex", "side", "lang", (base + F.col("place")).alias("node_id"),
        F.when(F.col("parent") == 0, F.lit(0)).otherwise(base + F.col("parent")).cast("bigint").alias("parent_id"),
        (F.when(F.col("parent") == 0, F.col("unit") * 8).otherwise(0) + F.col("ord0")).cast("bigint").alias("ord"),
        "type", F.nullif("field", F.lit("")).alias("field"), (F.col("leaf") != "token").alias("is_named"),
        F.when(F.col("leaf") == "leaf", F.lower(F.substring("w", 1, 2))).when(F.col("leaf") == "token", F.col("type")).alias("text"))
    none = F.lit(None)
    roots = words.where("unit = 0 and word = 0").select(
        "ex", "side", "lang", F.lit(0).cast("bigint").alias("node_id"), none.cast("bigint").alias("parent_id"), F.lit(0).cast("bigint").alias("ord"),
        F.lit("program").alias("type"), none.cast("string").alias("field"), F.lit(True).alias("is_named"), none.cast("string").alias("text"))
    return roots.unionByName(inner)


_PLACES = ("case when k<13 then [2,4,5,7,9,10,12,15,18,19,23,24,25][k+1] when not is_for then [28,31,32][k-12] "
           "when k=13 then 29 when k=14 then case when lang='go' then 31 else 30 end else 32 end")

#: Words as the occurrences they become (statement numbers and blocks by arithmetic), and the graph of blocks.
SQL = {
    "code_words": f"""
        select *, u*64+({_PLACES}) as p from (
          select ex, side, lower(substr(w,1,2)) as name, pos//16 as u, pos%16 as k, pos%32>=16 or ex%7=4 as is_for,
            ['java','python','javascript','ruby','go','php','c_sharp'][ex%7+1] as lang, max(pos) over (partition by ex, side) as last
          from sidewords where w<>'')""",
    "code_occ": """
        select ex, side, lang, name, p as pos, u, k, case
            when k=0 then u*8+1 when k=3 then u*8+2 when k=6 and lang not in ('python','ruby') then u*8+3 when k=8 then u*8+4 when k=10 then u*8+5
            when k=14 and not is_for then u*8+6 when k=14 and lang='go' then u*8+6
            when k=13 and is_for and lang<>'go' then u*8+6 end as stmt,
          case when k in (0,1,2) then u*8+1 when k in (3,4,5) then u*8+2 when k=6 and lang not in ('python','ruby') then u*8+3 when k in (8,9) then u*8+4
            when k in (10,11) then u*8+5 when k in (14,15) and not is_for then u*8+6 when k=14 and lang='go' then u*8+6
            when k in (13,14) and is_for and lang<>'go' then u*8+6 end as within,
          case when k=0 or (k=13 and is_for and lang not in ('go','php','python','ruby')) then 'declaration'
            when (k=6 and lang not in ('python','ruby')) or (k=14 and lang='go') then 'increment' else 'assignment' end as kind,
          u*8+case when k<7 then 0 when k<10 then 1 when k<13 then 2 when k=15 and is_for and lang not in ('python','ruby') then 5
            when k=14 and lang='go' then 5 else 4 end as block
        from code_words""",
    "code_eo": """
        select o.*, case when o.stmt is null then 2*o.pos else 2*m.pos+1 end as eo, case when o.stmt is null then 'rhs' else 'lhs' end as role
        from code_occ o left join (select ex, side, within, max(pos) as pos from code_occ where within is not null group by all) m
          on m.ex=o.ex and m.side=o.side and m.within=o.stmt""",
    "code_units": """
        select ex, side, lang, is_for, u, max(k) as k, max(last) as last from code_words group by all""",
    "code_blocks": """
        select ex, side, u*8+a as block, u*8+b as succ from (
          select *, unnest([[0,1]]) as e, e[1] as a, e[2] as b from code_units where k>=7
          union all select *, [0,2], 0, 2 from code_units where k>=10 and lang<>'javascript'
          union all select *, [1,2], 1, 2 from code_units where k>=10 and lang='javascript'
          union all select *, [1,3], 1, 3 from code_units where k>=7 and (k<10 or lang<>'javascript')
          union all select *, [2,3], 2, 3 from code_units where k>=10
          union all select *, [0,3], 0, 3 from code_units where k>=7 and (k<10 or lang not in ('python','ruby'))
          union all select *, [3,4], 3, 4 from code_units where k>=13
          union all select *, [4,4], 4, 4 from code_units where k>=13 and (not is_for or lang in ('python','ruby'))
          union all select *, [4,5], 4, 5 from code_units where is_for and lang not in ('python','ruby') and k>=case when lang='go' then 14 else 15 end
          union all select *, [5,5], 5, 5 from code_units where is_for and lang not in ('python','ruby') and k>=case when lang='go' then 14 else 15 end
          union all select *, [4,8], 4, 8 from code_units where last>=u*16+16 and (not is_for or lang in ('python','ruby'))
          union all select *, [5,8], 5, 8 from code_units where last>=u*16+16 and is_for and lang not in ('python','ruby'))""",
    "code_made": """
        select l.ex, l.side, l.name, l.pos, case when l.kind='declaration' then 'comesFrom' else 'computedFrom' end as relation, r.name as pn, r.pos as pp
        from code_occ l left join code_occ r on r.ex=l.ex and r.side=l.side and r.within=l.stmt and (r.stmt is null or l.kind='increment')
        where l.stmt is not null and (l.kind='declaration' or r.pos is not null)""",
}
