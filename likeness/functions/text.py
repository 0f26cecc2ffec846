"""Column expressions that clean, normalise and tokenise text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token grammar of the analysed language and its whitespace.
#   words with array brackets, increments, two-character comparisons, string and
#   character literals, then any other visible character.
# The quoted branches are possessive, so long literals cannot exhaust the regex stack.
LINE_END = r"\n\r\x{2028}\x{2029}"
SPACE = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
TOKEN_PATTERN = (
    r"\w+(?:\[\])*"
    r"|\+\+|--"
    r"|[<>=!]="
    r'|"(?:[^"\\]++|\\[^' + LINE_END + r'])*+"'
    r"|'(?:[^'\\]++|\\[^" + LINE_END + r"])*+'"
    r"|[^" + SPACE + r"]"
)
COMMENT_PATTERN = r"/(?:/[^" + LINE_END + r"]*|\*[\s\S]*?\*/)"
LINE_COMMENT_PATTERN = r"//[^\n]*"
BLOCK_COMMENT_PATTERN = r"/\*[\s\S]*?\*/"
SPACE_RUN_PATTERN = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# Word tokens for embeddings: an ellipsis or dash, one bracket or mark, or a run of the rest.
WORD_PATTERN = r"\.\.\.|--|[\[\](){}<>;,:@#$%&?!\"]|[^\s\[\](){}<>;,:@#$%&?!\"]+"


def strip_comments(code: Column) -> Column:
    """Drop line and block comments in one leftmost pass; quotes are not looked at."""
    return F.regexp_replace(code, COMMENT_PATTERN, "")


def normalize_code(code: Column) -> Column:
    """Drop line comments, then block comments, then squeeze whitespace to single spaces."""
    without_lines = F.regexp_replace(code, LINE_COMMENT_PATTERN, "")
    without_blocks = F.regexp_replace(without_lines, BLOCK_COMMENT_PATTERN, "")
    return F.trim(F.regexp_replace(without_blocks, SPACE_RUN_PATTERN, " "))


def tokenize(code: Column) -> Column:
    """Ordered code tokens of a text, comments left out."""
    return F.regexp_extract_all(strip_comments(code), F.lit(TOKEN_PATTERN), F.lit(0))


def word_tokens(code: Column) -> Column:
    """Ordered word tokens of a normalised text, the vocabulary of the embedding models."""
    return F.regexp_extract_all(normalize_code(code), F.lit(WORD_PATTERN), F.lit(0))


def first_word(code: Column) -> Column:
    """The first of the word tokens, null if there is none; the others are not cut."""
    return F.nullif(F.regexp_extract(normalize_code(code), WORD_PATTERN, 0), F.lit(""))
