"""Tokens, comments, lines and subwords."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers, trainers

from corpuslab.config import CorpusSpec
from corpuslab.functions import text
from corpuslab.functions.arrays import gram_keys, ngrams, numbered
from corpuslab.operators import subwords
from corpuslab.operators.comments import strip_comments


def value(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("v")).first().v


@pytest.mark.parametrize("line, want", [
    ("public int foo_1(int a) {", "▁ public ▁ int ▁ foo_1 ( int ▁ a ) ▁ {"),
    ("a  b", "▁ a ▁ ▁ b"), ("é ñ1.5", "▁ é ▁ ñ1 . 5"), ("", ""), ("int a;", "▁ int ▁ a ;"),
])
def test_word_tokens(spark, line, want):
    assert " ".join(value(spark, text.word_tokens(F.col("x")), x=line)) == want


def test_word_tokens_equal_public_library(spark):
    library = pre_tokenizers.Sequence([pre_tokenizers.Metaspace(), pre_tokenizers.Split(Regex(r"\W"), "isolated")])
    for line in ["x = y[0] + 'ä ö';", "日本 語_1", "a\tb", "π≈3.14", "__init__(self)"]:
        want = [w for w, _ in library.pre_tokenize_str(line)]
        assert value(spark, text.word_tokens(F.col("x")), x=line) == want


def test_lines_and_strip(spark):
    assert value(spark, text.snippet_lines(F.col("x")), x="\n  a \n\n b \n") == ["a", "", "b"]
    assert value(spark, text.space_tokens(F.col("x")), x=" a b\x1fc \n") == "a b\x1fc".split()


def test_reference_text(spark):
    m = [["▁int", "$$er", "▁a"], [], ["▁", ";"]]
    df = spark.createDataFrame([(m,)], "m array<array<string>>")
    assert df.select(text.reference_text(F.col("m"))).first()[0] == "inter a ;"


def test_block_records(spark):
    got = value(spark, text.block_records(F.col("x"), "\n}\n"), x="a\n}\nb {\n}\ntail")
    assert got == ["a\n}\n", "b {\n}\n"]
    assert value(spark, text.block_records(F.col("x"), "\n}\n"), x="none") == []


@pytest.mark.parametrize("code, want", [
    ("int a; // c\nint b;", "int a;  \nint b;"), ("s = \"//no\" + '/*';", "s = \"//no\" + '/*';"),
    ("a /* open", "a /* open"), ('un "term // x', 'un "term  '), ("a/*x\ny*/b\n\n  \nc", "a b\nc"),
    ("x = '\\'' + \"\\\\\"; // e", "x = '\\'' + \"\\\\\";  "),
])
def test_c_comments(spark, code, want):
    assert value(spark, text.strip_c_comments(F.col("x")), x=code) == want


def test_long_literal_does_not_exhaust_the_stack(spark):
    code = '"' + "a" * 60_000 + '" // c'
    assert value(spark, text.strip_c_comments(F.col("x")), x=code) == code[:-4] + " "


def test_python_comments(spark):
    code = '"""doc"""\nx = "keep"  # gone\n\ndef f():\n    "doc"\n    return x\n'
    rows = [(0, code), (1, "def broken(:\n  '''"), (2, "# all\n")]
    df = spark.createDataFrame(rows, "id bigint, code string")
    got = {r.id: r.code for r in df.withColumn("code", text.strip_python_comments(F.col("code"))).collect()}
    assert got[0] == 'x = "keep"  \ndef f():\n    return x'
    assert got[1] == rows[1][1]
    assert got[2] == ""


@pytest.mark.parametrize("code, want", [
    ("x = '#'  # c", "x = '#'  "), ('x = "a\\"#b"#c', 'x = "a\\"#b"'), ("f('''a\n# b''')", "f('''a\n# b''')"),
    ("r'''doc\n\nmore'''\ny", "y"), ("x = ''\ny = \"\" # z", "x = ''\ny = \"\" "), ("s = '" + "a" * 50000 + "'#", "s = '" + "a" * 50000 + "'"),
])
def test_python_strings(spark, code, want):
    assert value(spark, text.strip_python_comments(F.col("x")), x=code) == want


def test_strip_by_language(spark):
    rows = [("python", "a # x"), ("ruby", "a # x"), ("java", "a // x"), (None, "b // y")]
    df = spark.createDataFrame(rows, "lang string, code string")
    got = {r.lang: r.code for r in strip_comments(df).collect()}
    assert got == {"python": "a ", "ruby": "a # x", "java": "a  ", None: "b  "}


def test_ngram_padding(spark):
    df = spark.createDataFrame([(["1", "2", "3", "4", "5"],)], "w array<string>")
    right = df.select(ngrams(F.col("w"), 2, pad_right=True, right_symbol="E")).first()[0]
    assert right == [["1", "2"], ["2", "3"], ["3", "4"], ["4", "5"], ["5", "E"]]
    assert df.select(ngrams(F.col("w"), 6)).first()[0] == []
    assert len(df.select(ngrams(F.col("w"), 3, True, True, "S", "E")).first()[0]) == 7


def test_numbered_copies(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "w array<string>")
    got = [[t.replace("\x1f", "") for t in r[0]] for r in df.select(F.expr(numbered("w"))).collect()]
    assert got == [["a1", "b1", "b2"], []]
    assert df.select(F.expr(gram_keys("w", 2))).collect()[0][0] == ["b\x1fa", "a\x1fb"]


CORPUS = "low " * 5 + "lower " * 2 + "newest " * 6 + "widest " * 3


def test_merges_equal_the_hand_made_case(spark):
    df = spark.createDataFrame([(CORPUS.strip(),)], "text string")
    specials = ["<unk>"]
    letters, merges = subwords.train_merges(subwords.word_counts(df, "text"), 40, specials)
    lib = Tokenizer(models.BPE(unk_token="<unk>"))
    lib.pre_tokenizer = pre_tokenizers.Metaspace()
    lib.train_from_iterator([CORPUS.strip()], trainers.BpeTrainer(
        vocab_size=40, special_tokens=specials, continuing_subword_prefix="$$", show_progress=False))
    assert set(letters) <= set(lib.get_vocab())
    counts = [c for _, _, c in merges]
    assert counts[:6] == [9, 9, 7, 7, 7, 6] and counts == sorted(counts, reverse=True)
    assert {("$$e", "$$s"), ("$$es", "$$t")} <= {(a, b) for a, b, _ in merges[:3]}


def plain_merges(words, alphabet, size, n_specials):
    """One merge at a time, by count and then text."""
    split = {w: [w[0], *["$$" + c for c in w[1:]]] for w in words}
    out = []
    while n_specials + len(alphabet) + len(out) < size:
        counts = {}
        for w, n in words.items():
            for p in zip(split[w], split[w][1:]):
                counts[p] = counts.get(p, 0) + n
        if not counts:
            break
        (a, b), c = min(counts.items(), key=lambda kv: (-kv[1], kv[0][0].encode(), kv[0][1].encode()))
        out.append((a, b, c))
        for w, parts in split.items():
            i, new = 0, []
            while i < len(parts):
                if parts[i:i + 2] == [a, b]:
                    new.append(a + b.removeprefix("$$"))
                    i += 2
                else:
                    new.append(parts[i])
                    i += 1
            split[w] = new
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batched_rounds_equal_single_merges(spark, seed):
    import random

    rng = random.Random(seed)
    words = {}
    for _ in range(60):
        w = "▁" + "".join(rng.choice("aabcde") for _ in range(rng.randint(1, 9)))
        words[w] = words.get(w, 0) + rng.randint(1, 30)
    df = spark.createDataFrame(list(words.items()), "word string, cnt bigint")
    letters, merges = subwords.train_merges(df, 60, ["<unk>"])
    assert merges == plain_merges(words, letters, 60, 1)


def test_subword_encoding(spark):
    df = spark.createDataFrame([(CORPUS.strip(),)], "text string")
    letters, merges = subwords.train_merges(subwords.word_counts(df, "text"), 40, ["<unk>"])
    lines = spark.createDataFrame([(0, "lowest Zed low")], "id bigint, line string")
    marked = subwords.encode_lines(lines, "line", letters, merges, restore=False).first().tokens
    assert marked == ["▁low", "$$est", "▁", "<unk>", "$$e", "$$d", "▁low"]
    restored = subwords.encode_lines(lines, "line", letters, merges).first().tokens
    assert restored == ["▁low", "$$est", "▁", "Z", "$$e", "$$d", "▁low"]


def test_special_token_order():
    spec = CorpusSpec()
    assert spec.special_tokens()[:4] == ["<pad>", "<unk>", "<cs>", "</cs>"] and len(spec.special_tokens()) == 11
    assert spec.reversed().flags1.line_start == "<java>" and spec.first_line(2) == ["<java>", "<JAVA>", "</java>"]
