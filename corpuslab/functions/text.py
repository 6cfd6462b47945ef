"""Text and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.config import BLANK_MARK, CONTINUE_MARK

# White space as Python's str.split and str.strip see it.
SPACE = r"[\s\x1c-\x1f]"
SPACE_RUN = "(?U)" + SPACE + "+"

# The characters str.strip removes.
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Comment, or literal (possessive, so that long literals cannot exhaust the stack), or rest.
CODE_PIECE = (
    r"//[^\n]*"
    r"|/\*(?s:.*?)\*/"
    r"|'(?:\\(?s:.)|[^\\'])*+'"
    r'|"(?:\\(?s:.)|[^\\"])*+"'
    r"|[^/'\"]+"
    r"|(?s:.)"
)


def strip(text: Column) -> Column:
    """Unicode strip of both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def snippet_lines(code: Column) -> Column:
    """Lines of a stripped snippet, each stripped again."""
    return F.transform(F.split(strip(code), "\n", -1), strip)


def word_tokens(line: Column) -> Column:
    """Word mode: blanks become marks, one mark leads, every non-word character stands alone."""
    marked = F.concat(F.lit(BLANK_MARK), F.replace(line, F.lit(" "), F.lit(BLANK_MARK)))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(marked, F.lit(r"(?U)\w+|\W"), 0)
    )


def token_matrix(code: Column) -> Column:
    """Word-mode tokens per line."""
    return F.transform(snippet_lines(code), word_tokens)


def drop_empty(matrix: Column) -> Column:
    """Without empty tokens and then without empty lines."""
    return F.filter(
        F.transform(matrix, lambda line: F.filter(line, lambda t: t != "")),
        lambda line: F.size(line) > 0,
    )


def flat_tokens(matrix: Column) -> Column:
    return F.filter(F.flatten(matrix), lambda t: t != "")


def space_tokens(text: Column) -> Column:
    """Tokens between white space, as scoring reads them."""
    return F.filter(F.split(text, SPACE_RUN, -1), lambda t: t != "")


def plain_line(tokens: Column) -> Column:
    """Tokens of one line back to text."""
    whole = F.replace(F.array_join(tokens, ""), F.lit(CONTINUE_MARK), F.lit(""))
    return strip(F.replace(whole, F.lit(BLANK_MARK), F.lit(" ")))


def reference_text(matrix: Column) -> Column:
    """Token matrix to a one-line reference."""
    return F.array_join(F.transform(drop_empty(matrix), plain_line), " ")


def drop_blank_lines(code: Column) -> Column:
    return F.array_join(
        F.filter(F.split(code, "\n", -1), lambda x: F.length(strip(x)) > 0), "\n"
    )


def strip_c_comments(code: Column) -> Column:
    """Comments become one blank, literals stay, blank lines go."""
    pieces = F.transform(
        F.regexp_extract_all(code, F.lit(CODE_PIECE), 0),
        lambda p: F.when(p.startswith("//") | p.startswith("/*"), " ").otherwise(p),
    )
    return drop_blank_lines(F.array_join(pieces, ""))


#: A string literal: three quotes to the next three, or one to the next on its line.
_STRING = (
    r'(?:"{3}[\s\S]*?"{3}' + r"|'{3}[\s\S]*?'{3}"
    + r'|"(?!"")[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + r"|'(?!'')[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')"
)
PYTHON_PIECE = rf"(?m)(^[ \t]*)[rRuUbB]?{_STRING}|({_STRING})|#[^\n]*"


def strip_python_comments(code: Column) -> Column:
    """Comments and strings that begin a line go, other strings stay, blank lines go.

    A string that begins a line inside brackets counts as one too.
    """
    return drop_blank_lines(F.regexp_replace(code, F.lit(PYTHON_PIECE), F.lit("$1$2")))


def lower_unless(token: Column, keep: list[str]) -> Column:
    return F.when(token.isin(keep), token).otherwise(F.lower(token))


def block_records(text: Column, delimiter: str) -> Column:
    """Pieces that end with the delimiter; a tail without one is dropped."""
    quoted = "\\Q" + delimiter + "\\E"
    return F.transform(
        F.slice(F.split(text, quoted, -1), 1, F.size(F.split(text, quoted, -1)) - 1),
        lambda p: F.concat(p, F.lit(delimiter)),
    )
