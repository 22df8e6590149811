"""What regular expressions find in source code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no function names.
NOT_CALLED = ["sizeof", "typeof", "alignof"]
C_KEYWORDS = ["void", "int", "char", "float", "double", "long", "short", "signed", "unsigned", "const", "volatile", "static", "extern", "struct", "union", "enum", "typedef", "return", "if", "else", "while", "for", "do", "switch", "case", "break", "continue", "default", "sizeof", "typeof", "inline", "register", "goto", "restrict", "bool", "true", "false"]
# Patterns whose text decides the result.
INCLUDE = r'(?m)^\s*#\s*include\s+"([^"]+)"'
CALL = r"\b([A-Za-z_]\w*)\s*\("
COMMENT = r"(?s)/\*.*?\*/|//[^\n]*"
ANY_INCLUDE = r'#include\s+[<"]([^>"]+)[>"]'
MACRO = r"#define\s+([a-zA-Z_][a-zA-Z0-9_]*)"
CALLED = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
COMMENT_REFERENCE = r"\b([a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)|[A-Z][A-Z0-9_-]{2,})"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def include_headers(text: Column, pattern: str = INCLUDE) -> Column:
    """Names that the pattern's first group finds, each once, in order."""
    names = F.transform(F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(1)), lambda h: F.trim(h))
    return F.array_distinct(F.filter(names, lambda h: F.length(h) > 0))


def calls(text: Column) -> Column:
    """Names before an opening parenthesis, in order and with repetitions."""
    return F.filter(F.regexp_extract_all(_text(text), F.lit(CALL), F.lit(1)), lambda n: ~n.isin(NOT_CALLED + C_KEYWORDS))


def structs(text: Column) -> Column:
    """Names after ``struct``, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_text(text), F.lit(r"\bstruct\s+([A-Za-z_]\w*)"), F.lit(1))))


def syntax_tokens(text: Column) -> Column:
    """Included files in either quotes, defined macros, called names and references in comments."""
    body = _text(text)
    all_of = lambda where, pattern, group=1: F.regexp_extract_all(where, F.lit(pattern), F.lit(group))
    comments = F.array_join(all_of(body, COMMENT, 0), " ")
    return F.struct(
        all_of(body, ANY_INCLUDE).alias("includes"),
        all_of(body, MACRO).alias("macros"),
        F.array_except(all_of(body, CALLED), F.array(*map(F.lit, C_KEYWORDS))).alias("functions"),
        all_of(comments, COMMENT_REFERENCE).alias("comment_refs"),
    )
