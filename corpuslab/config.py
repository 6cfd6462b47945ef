"""Corpus description: sides, special tokens, limits and fixed word lists."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SideFlags:
    """Marker tokens of one side of the corpus."""

    line_start: str
    line_end: str
    code_start: str
    code_end: str

    def all(self) -> list[str]:
        return [self.line_start, self.line_end, self.code_start, self.code_end]


# Special tokens, in id order.
PAD = "<pad>"
UNK = "<unk>"
CROSS_LINE = "<cl>"
CS_FLAGS = SideFlags("<cs>", "</cs>", "<CS>", "</CS>")
JAVA_FLAGS = SideFlags("<java>", "</java>", "<JAVA>", "</JAVA>")

BLANK_MARK = "▁"
CONTINUE_MARK = "$$"

# Metric and decode constants.
BLEU_ORDER = 4
SMOOTH_EPSILON = 0.1
SMOOTH_ALPHA = 5
SMOOTH_K = 5
TINY = 2.2250738585072014e-308
KEYWORD_WEIGHT = 1.0
OTHER_WEIGHT = 0.2
LENGTH_STEP = 20
LENGTH_BUCKETS = 10
TOP_K_LINES = 10
MASK_PENALTY = -1e10
LOG_GUARD = 1e-10
KEEP_CHECKPOINTS = 3
BLOCK_DELIMITER = "\n}\n"

# Histogram edges of the corpus statistics.
SNIPPET_TOKEN_EDGES = (60, 130, 200, 300)
SNIPPET_LINE_EDGES = (3, 5, 10, 15)
LINE_TOKEN_EDGES = (5, 10, 20, 30)

# Languages that can be named, with the short name that stands for another one.
LANGUAGES = ("java", "javascript", "c_sharp", "php", "go", "python", "ruby")
LANGUAGE_ALIASES = {"js": "javascript"}

# Keywords per language.
KEYWORDS = {
    "java": (
        "abstract assert boolean break byte case catch char class const continue default do double "
        "else enum extends final finally float for goto if implements import instanceof int "
        "interface long native new package private protected public return short static strictfp "
        "super switch synchronized this throw throws transient try void volatile while"
    ).split(),
    "c_sharp": (
        "abstract as base bool break byte case catch char checked class const continue decimal "
        "default delegate do double else enum event explicit extern false finally fixed float for "
        "foreach goto if implicit in int interface internal is lock long namespace new null object "
        "operator out override params private protected public readonly ref return sbyte sealed "
        "short sizeof stackalloc static string struct switch this throw true try typeof uint ulong "
        "unchecked unsafe ushort using virtual void volatile while add alias ascending async await "
        "by descending dynamic equals from get global group into join let nameof notnull on "
        "orderby partial remove select set unmanaged value var when where yield"
    ).split(),
    "python": (
        "False None True and as assert async await break class continue def del elif else except "
        "finally for from global if import in is lambda nonlocal not or pass raise return try "
        "while with yield"
    ).split(),
}


@dataclass(frozen=True)
class CorpusSpec:
    """What a data set plugs into the jobs: its two sides, its markers and its limits."""

    key1: str = "cs"
    key2: str = "java"
    flags1: SideFlags = CS_FLAGS
    flags2: SideFlags = JAVA_FLAGS
    vocab_size: int = 4000
    word_limit: int = 12
    line_limit: int = 20
    token_limit: int = 300
    splits: tuple[str, ...] = ("train", "valid", "test")
    extra_specials: tuple[str, ...] = field(default=())

    def special_tokens(self) -> list[str]:
        return [PAD, UNK, *self.flags1.all(), *self.flags2.all(), CROSS_LINE, *self.extra_specials]

    def flags(self, side: int) -> SideFlags:
        return self.flags1 if side == 1 else self.flags2

    def first_line(self, side: int) -> list[str]:
        """Tokens of the line fed to the decoder before its first output line."""
        f = self.flags(side)
        return [f.line_start, f.code_start, f.line_end]

    def reversed(self) -> "CorpusSpec":
        """The same corpus translated the other way round."""
        return CorpusSpec(
            self.key2, self.key1, self.flags2, self.flags1, self.vocab_size, self.word_limit,
            self.line_limit, self.token_limit, self.splits, self.extra_specials,
        )

# Syntax node types that hold text as a whole or are skipped.
STRING_NODE_TYPES = ("string_literal", "string", "character_literal")
COMMENT_NODE_TYPE = "comment"

# Node types per language and statement role.
STATEMENT_TYPES = {
    "python": {
        "declaration": ["default_parameter"],
        "assignment": ["assignment", "augmented_assignment", "for_in_clause"],
        "if": ["if_statement"],
        "for": ["for_statement"],
        "while": ["while_statement"],
    },
    "java": {
        "declaration": ["variable_declarator"],
        "assignment": ["assignment_expression"],
        "increment": ["update_expression"],
        "if": ["if_statement"],
        "for": ["for_statement"],
        "for_each": ["enhanced_for_statement"],
        "while": ["while_statement"],
    },
    "c_sharp": {
        "declaration": ["variable_declarator"],
        "assignment": ["assignment_expression"],
        "increment": ["postfix_unary_expression"],
        "if": ["if_statement"],
        "for": ["for_statement"],
        "for_each": ["for_each_statement"],
        "while": ["while_statement"],
    },
    "ruby": {
        "declaration": ["keyword_parameter"],
        "assignment": ["assignment", "operator_assignment"],
        "if": ["if", "elsif", "else", "unless", "when"],
        "for": ["for"],
        "while": ["while_modifier", "until"],
    },
    "go": {
        "declaration": ["var_spec"],
        "assignment": ["assignment_statement"],
        "increment": ["inc_statement"],
        "if": ["if_statement"],
        "for": ["for_statement"],
    },
    "php": {
        "declaration": ["simple_parameter"],
        "assignment": ["assignment_expression", "augmented_assignment_expression"],
        "increment": ["update_expression"],
        "if": ["if_statement", "else_clause"],
        "for": ["for_statement"],
        "for_each": ["foreach_statement"],
        "while": ["while_statement"],
    },
    "javascript": {
        "declaration": ["variable_declarator"],
        "assignment": ["assignment_pattern", "augmented_assignment_expression"],
        "increment": ["update_expression"],
        "if": ["if_statement"],
        "for": ["for_statement"],
        "while": ["while_statement"],
    },
}

# Plain statements the table above leaves out; used only on request.
STATEMENT_GAPS = {
    "javascript": {"assignment": ["assignment_expression"]},
    "go": {"declaration": ["short_var_declaration"], "increment": ["dec_statement"]},
}

# What a labelled child is to its statement, per language ("" for all) and role.
SIDE_FIELDS = {
    ("", "declaration"): {"name": "lhs", "value": "rhs"},
    ("php", "declaration"): {"default_value": "rhs"},
    ("", "assignment"): {"left": "lhs", "right": "rhs"},
    ("java", "for_each"): {"name": "lhs", "value": "rhs", "body": "body"},
    ("c_sharp", "for_each"): {"left": "lhs", "right": "rhs", "body": "body"},
    ("php", "for_each"): {"body": "body"},
    ("python", "for"): {"left": "lhs", "right": "rhs", "body": "body"},
    ("ruby", "for"): {"pattern": "lhs", "value": "rhs", "body": "body"},
}
# The same where children have no labels, by their place.
SIDE_PLACES = {
    ("c_sharp", "declaration"): {0: "lhs", 1: "rhs"},
    ("php", "for_each"): {2: "rhs", 4: "lhs"},
}
# Children of an if that start a branch of their own, with all that follows them.
BRANCH_TYPES = {
    "python": ["elif_clause", "else_clause"],
    "java": ["if_statement", "else"],
    "c_sharp": ["if_statement", "else"],
    "ruby": ["if", "elsif", "else", "unless", "when"],
    "go": ["if_statement", "else"],
    "php": ["if_statement", "else_clause"],
    "javascript": ["if_statement", "else"],
}
# Languages whose state before an if goes on behind it even with an else.
KEEPS_BEFORE = ("go", "php", "javascript")
# The child of a for loop behind which its second pass starts.
LOOP_ENTRY = {
    "java": "local_variable_declaration",
    "c_sharp": "local_variable_declaration",
    "go": "for_clause",
    "php": "assignment_expression",
    "javascript": "variable_declaration",
}
