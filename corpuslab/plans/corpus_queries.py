"""Sources, sinks, text and vocabulary operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.config import CS_FLAGS, JAVA_FLAGS
from corpuslab.functions.arrays import joined
from corpuslab.functions.text import (
    block_records,
    flat_tokens,
    lower_unless,
    plain_line,
    reference_text,
    snippet_lines,
    strip_c_comments,
    strip_python_comments,
    word_tokens,
)
from corpuslab.operators import encode, rowcodes, statistics, subwords, vocab
from corpuslab.operators.comments import strip_comments
from corpuslab.plans.registry import query
from corpuslab.plans.tables import SPEC
from corpuslab.session import cut_lineage, scratch_path
from corpuslab.sources import corpus, text



def one_line(c: str) -> Column:
    return F.replace(F.col(c), F.lit("\n"), F.lit(" "))


# -- sources and sinks ---------------------------------------------------------------------

@query("src_aligned_pairs", """
    select split, row_number() over (partition by split order by idx)-1 as idx,
      trim(replace(key1,chr(10),' ')) as key1, trim(replace(key2,chr(10),' ')) as key2 from pairs""")
def src_aligned_pairs(t):
    base = scratch_path(t.spark, "aligned")
    out = None
    for split in SPEC.splits:
        part = t.pairs.filter(F.col("split") == split)
        for key in ("key1", "key2"):
            text.write_lines(part.withColumn("line", one_line(key)), "line", ["idx"], f"{base}/{split}.{key}")
        read = text.read_pairs(t.spark, f"{base}/{split}.key1", f"{base}/{split}.key2", split)
        out = read if out is None else out.unionByName(read)
    return out


@query("src_alignment_report", """
    select d.lang, count(*) filter (l.doc_id is null)::bigint as left_only, count(*) filter (l.doc_id is not null)::bigint as both
    from documents d left join labels l using (doc_id) group by d.lang
    union all select 'all', (select count(*) from documents anti join labels using (doc_id)),
      (select count(*) from documents semi join labels using (doc_id))""")
def src_alignment_report(t):
    labels = t.read("labels").select("doc_id")
    whole = text.alignment_report(t.documents, labels, ["doc_id"]).select(
        F.lit("all").alias("lang"), "left_only", "both"
    )
    flagged = t.documents.select("doc_id", "lang").join(
        labels.distinct().withColumn("hit", F.lit(1)), "doc_id", "left"
    )
    per = flagged.groupBy("lang").agg(
        F.count_if(F.col("hit").isNull()).alias("left_only"), F.count("hit").alias("both")
    )
    return per.unionByName(whole)


@query("src_prediction_alignment", """
    select model, count(*)::bigint as both, 0::bigint as left_only, 0::bigint as right_only from preds group by model""")
def src_prediction_alignment(t):
    refs = t.segments.select("idx").withColumn("_r", F.lit(1))
    marked = t.preds.select("model", "idx").withColumn("_p", F.lit(1)).join(refs, "idx", "full_outer")
    has_p, has_r = F.col("_p").isNotNull(), F.col("_r").isNotNull()
    return marked.groupBy("model").agg(
        F.count_if(has_p & has_r).alias("both"), F.count_if(~has_p).alias("left_only"),
        F.count_if(~has_r).alias("right_only"),
    )


@query("src_split_counts", """
    select split, count(*)::bigint as lines, sum(length(replace(key1,chr(10),' ')))::bigint as chars from pairs group by split""")
def src_split_counts(t):
    base = scratch_path(t.spark, "splits")
    for split in SPEC.splits:
        part = t.pairs.filter(F.col("split") == split)
        part.select(one_line("key1").alias("value")).write.text(f"{base}/{split}.part")
    # the part folders play the files' role, so the split stands in the folder name
    lines = t.spark.read.option("recursiveFileLookup", "true").text(base).select(
        text.split_of(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")).alias("split"), "value"
    )
    return lines.groupBy("split").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).cast("bigint").alias("chars")
    )


@query("src_block_records", """
    select doc_id, generate_subscripts(p,1)-1 as rec_no, unnest(p)||'.'||chr(10) as record from (
      select doc_id, string_split(text,'.'||chr(10))[:-2] as p from documents) where len(p)>0""")
def src_block_records(t):
    return t.documents.select(
        "doc_id", F.posexplode(block_records(F.col("text"), ".\n")).alias("rec_no", "record")
    ).withColumn("rec_no", F.col("rec_no").cast("bigint"))


@query("src_json_roundtrip", """
    with m as (select idx, side, count(*) as lines, sum(len(t)) as tokens from line_toks group by all)
    select p.idx, p.key1 as cs, p.key2 as java, coalesce(a.lines,0)::bigint as cs_lines, coalesce(a.tokens,0)::bigint as cs_tokens,
      coalesce(b.lines,0)::bigint as java_lines, coalesce(b.tokens,0)::bigint as java_tokens from pairs p
    left join m a on a.idx=p.idx and a.side='key1' left join m b on b.idx=p.idx and b.side='key2'""")
def src_json_roundtrip(t):
    from corpuslab.functions.text import drop_empty, token_matrix

    path = scratch_path(t.spark, "json")
    corpus.write_json(
        t.pairs.select("idx", F.col("key1").alias("cs"), F.col("key2").alias("java"),
                       token_matrix(F.col("key1")).alias("cs_t"), token_matrix(F.col("key2")).alias("java_t")),
        path,
    )
    back = corpus.read_json(t.spark, path, "cs", "java")
    sizes = []
    for k in ("cs", "java"):
        m = drop_empty(F.col(f"{k}_t"))
        sizes += [F.size(m).cast("bigint").alias(f"{k}_lines"), F.size(F.flatten(m)).cast("bigint").alias(f"{k}_tokens")]
    return back.select("idx", "cs", "java", *sizes)


@query("src_json_array", """
    select idx, replace(key1,',','}"{\\') as cs, replace(key2,' ',' {') as java, [len(key1), len(key2)]::varchar as sizes from pairs""")
def src_json_array(t):
    """The corpus as one JSON array for each split, with braces, quotes and backslashes in its texts.

    A split's array is cut between objects into part files, one for each range of numbers: no task writes a whole split."""
    path = scratch_path(t.spark, "json-array")
    made = t.pairs.select(
        "split", "idx", F.replace("key1", F.lit(","), F.lit('}"{\\')).alias("cs"), F.replace("key2", F.lit(" "), F.lit(" {")).alias("java"),
        F.struct(F.array(F.length("key1"), F.length("key2")).alias("n")).alias("sizes"))
    ends = made.groupBy("split").agg(F.min("idx").alias("_first"), F.max("idx").alias("_last"))
    lines = made.join(ends, "split").select("split", "idx", F.concat(
        F.when(F.col("idx") == F.col("_first"), "[").otherwise(" "), F.to_json(F.struct("idx", "cs", "java", "sizes")),
        F.when(F.col("idx") == F.col("_last"), "]").otherwise(",")).alias("value"))
    lines.repartitionByRange("split", "idx").sortWithinPartitions("split", "idx").select("split", "value").write.partitionBy("split").text(path)
    back = corpus.read_array(t.spark, path, "idx bigint, cs string, java string, sizes struct<n: array<int>>")
    return back.select("idx", "cs", "java", F.concat(F.lit("["), joined(F.col("sizes.n"), ", "), F.lit("]")).alias("sizes"))


@query("src_nested_parquet", """
    select split, count(distinct idx)::bigint as records, sum(len(t))::bigint as tokens from line_toks group by split""")
def src_nested_parquet(t):
    path = scratch_path(t.spark, "records")
    corpus.write_records(t.matrices, "tok1", "tok2", path)
    back = t.spark.read.parquet(path)
    both = F.size(F.flatten("tok1")) + F.size(F.flatten("tok2"))
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), F.sum(both).cast("bigint").alias("tokens")
    )


@query("sink_predictions_append", """
    select model, b.batch, count(*)::bigint as predictions, sum(length(hyp))::bigint as chars, sum(case when b.batch=1 then 1 else 0 end)::bigint as again
    from preds cross join (select unnest([0,1]) as batch) b group by all""")
def sink_predictions_append(t):
    path = scratch_path(t.spark, "predictions")
    for batch in (0, 1):
        corpus.append_predictions(t.preds.withColumn("batch", F.lit(batch)), path)
    written = t.spark.read.parquet(path)
    doubled = corpus.duplicate_predictions(written).select("model", "idx", "copies")
    rows = written.join(doubled, ["model", "idx"], "left")
    return rows.groupBy("model", "batch").agg(
        F.count(F.lit(1)).alias("predictions"), F.sum(F.length("hyp")).cast("bigint").alias("chars"),
        F.sum(F.when(F.col("copies").isNotNull() & (F.col("batch") == 1), 1).otherwise(0)).alias("again"),
    )


@query("sink_reference_text", """
    with l as (select idx, side, string_agg(trim(replace(replace(array_to_string(t,''),'$$',''),'▁',' ')), ' ' order by line_no) as ref
      from line_toks where split='test' group by all)
    select side, row_number() over (partition by side order by idx)-1 as idx, trim(ref) as ref from l""")
def sink_reference_text(t):
    test = t.matrices.filter(F.col("split") == "test")
    base, out = scratch_path(t.spark, "references"), None
    for side, col in (("key1", "tok1"), ("key2", "tok2")):
        text.write_lines(test.withColumn("ref", reference_text(F.col(col))), "ref", ["idx"], f"{base}/{side}")
        back = text.read_indexed_lines(t.spark, f"{base}/{side}").select(
            F.lit(side).alias("side"), "idx", F.col("line").alias("ref")
        )
        out = back if out is None else out.unionByName(back)
    return out


@query("src_golden_blocks", """
    select doc_id, 0::bigint as block_no, source as name, trim(replace(text,chr(10),' ')) as code, '(doc ('||lang||'))' as tree from documents
    union all select doc_id, 1, lang, 'size '||n_chars, '(size)' from documents""")
def src_golden_blocks(t):
    docs = t.read("documents")
    bar = "=" * 8
    content = F.concat(
        F.lit(f"{bar}\n"), "source", F.lit(f"\n{bar}\n\n"), F.trim(one_line("text")), F.lit("\n\n---\n\n(doc ("), "lang",
        F.lit(f"))\n\n{bar}\n"), "lang", F.lit(f"\n{bar}\n\nsize "), F.col("n_chars").cast("string"),
        F.lit("\n\n---\n\n(size)\n"),
    )
    return text.golden_blocks(docs.select("doc_id", content.alias("value")))


# -- text and tokens -------------------------------------------------------------------------

@query("tok_lines", "select idx as doc_id, line_no, line from side_lines where side='key1'")
def tok_lines(t):
    return t.documents.select(
        "doc_id", F.posexplode(snippet_lines(F.col("text"))).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("tok_words", """
    select idx as doc_id, line_no, len(t)::bigint as tokens, array_to_string(t,' ') as joined from line_toks where side='key1'""")
def tok_words(t):
    lines = t.documents.select("doc_id", F.posexplode(snippet_lines(F.col("text"))).alias("line_no", "line"))
    tok = lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), word_tokens(F.col("line")).alias("t"))
    return tok.filter(F.size("t") > 0).select(
        "doc_id", "line_no", F.size("t").cast("bigint").alias("tokens"), joined(F.col("t")).alias("joined")
    )


@query("tok_flatten", """
    select idx, side, count(*)::bigint as tokens, string_agg(token,'' order by line_no, pos) as joined from toks group by all""")
def tok_flatten(t):
    sides = F.array(*[
        F.struct(F.lit(k).alias("side"), flat_tokens(F.col(c)).alias("flat")) for k, c in (("key1", "tok1"), ("key2", "tok2"))
    ])
    return t.matrices.select("idx", F.inline(sides)).select(
        "idx", "side", F.size("flat").cast("bigint").alias("tokens"), joined(F.col("flat"), "").alias("joined")
    )


@query("detok_reference", """
    select idx, string_agg(trim(replace(replace(array_to_string(t,''),'$$',''),'▁',' ')), ' ' order by line_no) as ref
    from line_toks where side='key1' group by idx""")
def detok_reference(t):
    return t.matrices.select("idx", reference_text(F.col("tok1")).alias("ref"))


@query("tok_lower", """
    select id, case when id<=10 then token else lower(token) end as token from vocab""")
def tok_lower(t):
    return t.vocab.select("id", lower_unless(F.col("token"), SPEC.special_tokens()).alias("token"))


@query("txt_strip_comments", r"""
    with p as (select page_id, list_transform(regexp_extract_all(html,
        '//[^\n]*|/\*(?s:.*?)\*/|''(?:\\(?s:.)|[^\\''])*''|"(?:\\(?s:.)|[^\\"])*"|[^/''"]+|(?s:.)'),
        lambda x: case when starts_with(x,'//') or starts_with(x,'/*') then ' ' else x end) as pieces from pages)
    select page_id, array_to_string(list_filter(string_split(array_to_string(pieces,''),chr(10)), lambda x: trim(x)<>''),chr(10)) as code from p""")
def txt_strip_comments(t):
    pages = t.spread(t.read("pages").select("page_id", F.col("html").alias("code")))
    return pages.withColumn("code", strip_c_comments(F.col("code")))


@query("txt_strip_by_language", r"""
    with p as (select page_id, case when page_id%3=0 then 'ruby' else 'java' end as lang, html, list_transform(regexp_extract_all(html,
        '//[^\n]*|/\*(?s:.*?)\*/|''(?:\\(?s:.)|[^\\''])*''|"(?:\\(?s:.)|[^\\"])*"|[^/''"]+|(?s:.)'),
        lambda x: case when starts_with(x,'//') or starts_with(x,'/*') then ' ' else x end) as pieces from pages)
    select page_id, lang, case when lang='ruby' then html else array_to_string(list_filter(
      string_split(array_to_string(pieces,''),chr(10)), lambda x: trim(x)<>''),chr(10)) end as code from p""")
def txt_strip_by_language(t):
    pages = t.spread(t.read("pages")).select(
        "page_id", F.when(F.col("page_id") % 3 == 0, "ruby").otherwise("java").alias("lang"), F.col("html").alias("code")
    )
    return strip_comments(pages)


@query("txt_strip_py_comments", r"""
    select idx as doc_id, string_agg('x = "'||replace(replace(line,'\',''),'"','')||'"  ', chr(10) order by line_no) as code
    from side_lines where side='key1' group by idx""")
def txt_strip_py_comments(t):
    """Python source made of every line of a text: a docstring, then commented assignments."""
    safe = F.transform(
        snippet_lines(F.col("text")),
        lambda x: F.concat(F.lit('x = "'), F.translate(x, '\\"', ""), F.lit('"  # note')),
    )
    code = F.concat(F.lit('"""About\nthis."""\n\n'), F.array_join(safe, "\n"))
    return t.documents.select("doc_id", strip_python_comments(code).alias("code"))


#: Entries of the subword vocabulary that the named queries learn; the full size takes several times as long.
BPE_SIZE = 1000


def _trained(t):
    train = t.pairs.filter(F.col("split") == "train")
    both = train.select(F.explode(F.array("key1", "key2")).alias("text"))
    return subwords.train_merges(subwords.word_counts(both, "text"), BPE_SIZE, SPEC.special_tokens())


@query("bpe_train_merges")
def bpe_train_merges(t):
    """Merges in learnt order with the pair count each had; checked in the tests."""
    letters, merges = _trained(t)
    names = subwords.subword_vocab(letters, merges, SPEC.special_tokens())
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate(merges)]
    out = t.spark.createDataFrame(rows, "rank bigint, left string, right string, cnt bigint")
    return out.withColumn("vocab_size", F.lit(len(names)).cast("bigint"))


@query("bpe_encode", """
    select idx as doc_id, line_no, replace(line,'$$','') as text from side_lines where side='key1' and line<>''""")
def bpe_encode(t):
    """Encode every line with merges learnt from the corpus, then put the text back together."""
    letters, merges = _trained(t)
    lines = t.documents.select("doc_id", F.posexplode(snippet_lines(F.col("text"))).alias("line_no", "line"))
    coded = subwords.encode_lines(
        lines.withColumn("line_no", F.col("line_no").cast("bigint")).filter(F.col("line") != ""), "line", letters, merges
    )
    return coded.select("doc_id", "line_no", plain_line(F.col("tokens")).alias("text"))


@query("enc_subword_ids", """
    select idx as doc_id, line_no, replace(line,'$$','') as text from side_lines where side='key1' and line<>''""")
def enc_subword_ids(t):
    """Lines as ids of the learnt subword vocabulary, and from the ids back to text."""
    letters, merges = _trained(t)
    names = subwords.subword_vocab(letters, merges, SPEC.special_tokens())
    words = t.spark.createDataFrame(list(enumerate(names)), "id bigint, token string")
    lines = t.documents.select("doc_id", F.posexplode(snippet_lines(F.col("text"))).alias("line_no", "line"))
    coded = subwords.encode_lines(
        lines.withColumn("line_no", F.col("line_no").cast("bigint")).filter(F.col("line") != ""), "line", letters, merges
    ).withColumn("tokens", F.array("tokens"))
    ids = rowcodes.matrix_ids(coded, ["tokens"], words, "tokens", len(names))
    back = rowcodes.matrix_tokens(ids, ["tokens"], words, len(names))
    return back.select("doc_id", "line_no", plain_line(F.get("tokens", F.lit(0))).alias("text"))


# -- vocabulary and encoding -----------------------------------------------------------------

@query("vocab_build", "select id, token, id<=10 as is_special from vocab")
def vocab_build(t):
    return t.vocab


@query("vocab_truncate", """
    select id, token, (select min(id) from vocab where token='<pad>' and id<100) as pad_id,
      (select min(id) from vocab where token='<unk>' and id<100) as unk_id,
      (select min(id) from vocab where token='<java>' and id<100) as first_word_id,
      (select min(id) from vocab where token='<JAVA>' and id<100) as first_line_id from vocab where id<100""")
def vocab_truncate(t):
    cut = vocab.truncate_vocab(t.vocab, 100)
    ids = vocab.special_ids(cut, {
        "pad_id": "<pad>", "unk_id": "<unk>", "first_word_id": JAVA_FLAGS.line_start, "first_line_id": JAVA_FLAGS.code_start,
    })
    return cut.select("id", "token").withColumn("_k", F.lit(0)).join(ids.withColumn("_k", F.lit(0)), "_k").drop("_k")


@query("enc_token_ids", """
    select t.idx, t.side, t.line_no, string_agg(coalesce(v.id,1)::varchar,' ' order by t.pos) as ids
    from toks t left join vocab v using (token) group by all""")
def enc_token_ids(t):
    coded = rowcodes.matrix_ids(_sides(t), ["key1", "key2"], t.vocab)
    return _lines(coded, "ids")


@query("enc_flat_pad", """
    with f as (select idx, list(token order by line_no, pos) filter (side='key1') as a, list(token order by line_no, pos) filter (side='key2') as b from toks group by idx)
    select idx, array_to_string(list_resize(a[1:300],300,'<pad>'),' ') as source,
      array_to_string(list_resize(list_append(b,'</java>')[1:300],300,'<pad>'),' ') as target from f""")
def enc_flat_pad(t):
    limit = SPEC.token_limit
    return t.matrices.select(
        "idx", joined(encode.flat_padded(flat_tokens(F.col("tok1")), limit)).alias("source"),
        joined(encode.flat_padded(flat_tokens(F.col("tok2")), limit, JAVA_FLAGS.line_end)).alias("target"),
    )


def wrapped(t) -> DataFrame:
    return t.matrices.select(
        "idx", encode.wrap_lines(F.col("tok1"), SPEC.word_limit, SPEC.line_limit, CS_FLAGS).alias("rows")
    )


WRAP = """
    with c as (select idx, line_no, 0 as chunk, case when len(t)<12 then list_append(t,'</cs>') else list_append(t[1:11],'</cs>') end as r
        from line_toks where side='key1'
      union all select idx, line_no, i+1, list_append(list_prepend('<cl>', t[12+10*i:21+10*i]),'</cs>') from (
        select idx, line_no, t, unnest(range(0, ((len(t)-11+9)//10)::bigint)) as i from line_toks where side='key1' and len(t)>=12)
      union all select idx, 1000000000, 0, ['<cs>','</CS>','</cs>'] from pairs),
    n as (select idx, r, row_number() over (partition by idx order by line_no, chunk)-1 as row_no from c),
    g as (select p.idx, k.row_no from pairs p cross join (select unnest(range(20)) as row_no) k),
    wrapped as (select g.idx, g.row_no, list_resize(coalesce(n.r,[]),12,'<pad>') as r from g left join n on n.idx=g.idx and n.row_no=g.row_no)
"""


@query("enc_wrap_lines", WRAP + "select idx, row_no, array_to_string(r,' ') as row_text from wrapped")
def enc_wrap_lines(t):
    return wrapped(t).select("idx", F.posexplode("rows").alias("row_no", "r")).select(
        "idx", F.col("row_no").cast("bigint").alias("row_no"), joined(F.col("r")).alias("row_text")
    )


@query("enc_masks", WRAP + """
    select idx, row_no, array_to_string(list_transform(r, lambda x: case when x='<pad>' then '1' else '0' end),'') as word_mask,
      (len(list_filter(r, lambda x: x<>'<pad>'))=0)::int as line_mask from wrapped""")
def enc_masks(t):
    rows = wrapped(t).select("idx", F.posexplode("rows").alias("row_no", "r"))
    return rows.select(
        "idx", F.col("row_no").cast("bigint").alias("row_no"),
        joined(encode.word_mask(F.col("r")), "").alias("word_mask"), encode.line_mask(F.col("r")).alias("line_mask"),
    )


@query("detok_model_output", WRAP + """,
    b as (select idx, row_no, r[1]='<cl>' as follows, array_to_string(list_filter(r, lambda x: not list_contains(
        ['<pad>','<cs>','</cs>','<CS>','</CS>','<cl>'], x)),'') as txt from wrapped
      where not exists (select 1 from (select idx as i2, row_no as r2 from wrapped where list_contains(r,'</CS>')) e
        where e.i2=wrapped.idx and e.r2<=wrapped.row_no)),
    l as (select *, sum(case when follows then 0 else 1 end) over (partition by idx order by row_no) as grp from b),
    m as (select idx, grp, trim(replace(replace(string_agg(txt,'' order by row_no),'$$',''),'▁',' ')) as line, max(length(txt)) as len from l group by all)
    select idx, string_agg(line,' ' order by grp) as code from m where len>0 group by idx""")
def detok_model_output(t):
    lines = encode.output_lines(F.col("rows"), SPEC)
    return wrapped(t).select("idx", F.array_join(lines, " ").alias("code"))


@query("enc_oov_tokens", """
    select t.idx, t.line_no, t.token, min(t.pos)::bigint as first_pos from toks t anti join vocab v using (token)
    where t.side='key1' group by all""")
def enc_oov_tokens(t):
    source = t.toks.filter(F.col("side") == "key1")
    out = vocab.unknown_tokens(source, t.vocab, ["idx"])
    return out.select("idx", F.col("line_no").cast("bigint").alias("line_no"), "token", F.col("first_pos").cast("bigint").alias("first_pos"))


EXT = """
    with ext as (select idx, token, 3999+row_number() over (partition by idx order by ln, ps) as ext_id from (
      select idx, token, min(line_no) as ln, arg_min(pos, line_no*1000000+pos) as ps from toks t anti join vocab v using (token)
      where side='key1' group by all)),
    coded as (select t.idx, t.side, t.line_no, t.pos, t.token, coalesce(v.id, e.ext_id, 1) as id from toks t
      left join vocab v using (token) left join ext e on e.idx=t.idx and e.token=t.token)
"""


def _sides(t):
    return t.matrices.select("idx", F.col("tok1").alias("key1"), F.col("tok2").alias("key2"))


def _lines(coded, name):
    lines = rowcodes.matrix_lines(coded, ["key1", "key2"], ["idx"], name)
    return lines.select("idx", "side", "line_no", joined(F.col(name)).alias(name))


def _coded(t):
    """Both sides of a pair, with ids of the source's own tokens behind the vocabulary."""
    return rowcodes.matrix_ids(_sides(t), ["key1", "key2"], t.vocab, "key1", SPEC.vocab_size)


@query("enc_ext_vocab", EXT + "select idx, ext_id::bigint as ext_id, token from ext")
def enc_ext_vocab(t):
    own = _coded(t).select("idx", F.posexplode("own").alias("n", "token"))
    return own.select("idx", (F.col("n") + SPEC.vocab_size).cast("bigint").alias("ext_id"), "token")


@query("enc_ext_ids", EXT + """
    select idx, side, line_no, string_agg(id::varchar,' ' order by pos) as ids from coded group by all""")
def enc_ext_ids(t):
    return _lines(_coded(t), "ids")


@query("enc_restore_unk", EXT + """
    select idx, side, line_no, string_agg((case when id<4000 then id else 1 end)::varchar,' ' order by pos) as ids from coded group by all""")
def enc_restore_unk(t):
    plain = lambda c: F.transform(c, lambda line: F.transform(line, lambda i: vocab.plain_id(i, SPEC.vocab_size)))
    fed = _coded(t).select("idx", plain("key1").alias("key1"), plain("key2").alias("key2"))
    return _lines(fed, "ids")


@query("enc_decode_ids", EXT + """
    select c.idx, c.side, c.line_no, string_agg(coalesce(v.token, e.token),' ' order by c.pos) as decoded from coded c
    left join vocab v on v.id=c.id left join ext e on e.idx=c.idx and e.ext_id=c.id group by all""")
def enc_decode_ids(t):
    return _lines(rowcodes.matrix_tokens(_coded(t), ["key1", "key2"], t.vocab, SPEC.vocab_size), "decoded")


@query("pairs_reverse", "select idx, split, key2 as key1, key1 as key2, '<java>' as start_flag, '</cs>' as target_end from pairs")
def pairs_reverse(t):
    swapped, spec = encode.reverse_pairs(t.pairs, SPEC)
    return swapped.select(
        "idx", "split", "key1", "key2", F.lit(spec.flags1.line_start).alias("start_flag"),
        F.lit(spec.flags2.line_end).alias("target_end"),
    )


@query("batch_assign", """
    select split, idx, row_number() over (partition by split order by md5(idx||'|7'), idx) as rank,
      (row_number() over (partition by split order by md5(idx||'|7'), idx)-1)//40 as batch from pairs""")
def batch_assign(t):
    """Batch numbers in seeded order."""
    return encode.assign_batches(t.pairs.select("split", "idx"), "idx", 40, seed=7, within="split")


@query("batch_sizes", """
    select split, batch, count(*)::bigint as snippets from (
      select split, (row_number() over (partition by split order by idx)-1)//40 as batch from pairs) group by all""")
def batch_sizes(t):
    return batch_assign(t).groupBy("split", "batch").agg(F.count(F.lit(1)).alias("snippets"))


@query("batch_validation_sample", """
    with b as (select idx, (row_number() over (order by md5(idx||'|7'), idx)-1)//40 as batch from pairs where split='valid'),
    n as (select max(batch)+1 as n from b)
    select e.epoch::bigint as epoch, b.idx, b.batch from b cross join n cross join (select unnest(range(4)) as epoch) e
    where (b.batch - e.epoch*3 % n.n + n.n) % n.n < 3""")
def batch_validation_sample(t):
    """What four epochs are validated on: each goes on where the last one stopped."""
    valid = encode.assign_batches(t.pairs.filter(F.col("split") == "valid").select("idx"), "idx", 40, seed=7)
    valid = cut_lineage(valid)
    epochs = [encode.sample_batches(valid, 3, e).select(F.lit(e).cast("bigint").alias("epoch"), "idx", "batch") for e in range(4)]
    return reduce(lambda a, b: a.unionByName(b), epochs)


# -- statistics ------------------------------------------------------------------------------

_BINS = {"snip": (60, 130, 200, 300), "lines": (3, 5, 10, 15), "line": (5, 10, 20, 30)}


def _stat_sql(source: str, edges: tuple[int, ...]) -> str:
    lo, hi = [None, *edges], [*edges, None]
    bins = ", ".join(
        f"count(*) filter ({' and '.join(([f'v>={a}'] if a else []) + ([f'v<{b}'] if b else []))})::bigint as bin{i}"
        for i, (a, b) in enumerate(zip(lo, hi))
    )
    return (
        f"select side, count(*)::bigint as n, max(v)::bigint as max, round(avg(v),6) as mean, sum(v)::bigint as sum, {bins} "
        f"from ({source}) group by side"
    )


_SNIP = "select side, sum(len(t))::bigint as v from line_toks group by side, idx"
_LINES = "select side, count(*) as v from line_toks group by side, idx"
_LINE = "select side, len(t) as v from line_toks"


def _sizes(t):
    return statistics.line_sizes(t.matrices, {"key1": "tok1", "key2": "tok2"})


def _rounded(df):
    return df.withColumn("mean", F.round("mean", 6))


@query("stat_tokens_per_snippet", _stat_sql(_SNIP, _BINS["snip"]))
def stat_tokens_per_snippet(t):
    return _rounded(statistics.tokens_per_snippet(_sizes(t)))


@query("stat_lines_per_snippet", _stat_sql(_LINES, _BINS["lines"]))
def stat_lines_per_snippet(t):
    return _rounded(statistics.lines_per_snippet(_sizes(t)))


@query("stat_tokens_per_line", _stat_sql(_LINE, _BINS["line"]))
def stat_tokens_per_line(t):
    return _rounded(statistics.tokens_per_line(_sizes(t)))


@query("stat_corpus_summary", f"""
    with a as ({_stat_sql(_SNIP, _BINS['snip'])}), b as ({_stat_sql(_LINES, _BINS['lines'])}), c as ({_stat_sql(_LINE, _BINS['line'])}),
    u as (select 'tokens_per_snippet' as measure, * from a union all select 'lines_per_snippet', * from b union all select 'tokens_per_line', * from c)
    select side, measure, statistic, round(value,6)::double as value from (
      unpivot (select side, measure, n::double as n, max::double as max, mean, sum::double as sum, bin0::double as bin0, bin1::double as bin1,
        bin2::double as bin2, bin3::double as bin3, bin4::double as bin4 from u)
      on n, max, mean, sum, bin0, bin1, bin2, bin3, bin4 into name statistic value value)""")
def stat_corpus_summary(t):
    return statistics.corpus_report(_sizes(t)).withColumn("value", F.round("value", 6))
