"""Tags of chunks and the prefix that stands for them in retrieval text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.paths import contains_any

# Words that imply a role, in table order.
ROLES = {
    "file_io": ["READ", "WRITE", "REWRITE", "DELETE", "OPEN", "CLOSE", "START"],
    "display_io": ["DISPLAY", "ACCEPT"],
    "call_external": ["CALL", "GOBACK"],
    "control_flow": ["PERFORM", "IF", "END-IF", "EVALUATE", "END-EVALUATE", "GO ", "GO TO", "EXIT PROGRAM", "EXIT PARAGRAPH", "EXIT SECTION"],
    "data_definition": ["01 ", "77 ", "PIC ", "PICTURE ", "USAGE ", "VALUE ", "88 ", "REDEFINES", "OCCURS "],
    "business_logic": ["COMPUTE", "ADD ", "SUBTRACT", "MULTIPLY", "DIVIDE", "MOVE "],
    "error_handling": ["ON EXCEPTION", "NOT ON EXCEPTION", "INVALID KEY", "AT END", "NOT AT END"],
}
# What structural tags begin with.
PREFIXES = ["div:", "data:", "para:", "section:", "program:"]
# Sections of the data division that get a tag.
DATA_SECTIONS = ["WORKING-STORAGE", "LINKAGE", "FILE", "LOCAL-STORAGE"]


def tag_catalogue(spark: SparkSession) -> DataFrame:
    """(kind, tag, place): the roles and the prefixes that a filter can name."""
    rows = [("role_tags", t, k) for k, t in enumerate(ROLES)] + [("structural_prefixes", t, k) for k, t in enumerate(PREFIXES)]
    return spark.createDataFrame(rows, "kind string, tag string, place int")


def role_tags(snippet: Column) -> Column:
    """Roles whose words occur anywhere in the upper-cased text, as substrings."""
    upper = F.upper(F.coalesce(snippet, F.lit("")))
    return F.array_compact(F.array(*(F.when(contains_any(upper, words), F.lit(role)) for role, words in ROLES.items())))


def structural_tags(division: Column, section: Column, paragraph: Column, program: Column) -> Column:
    """div:, data:, para:, section: and program: tags of what is known."""
    known = lambda c: c.isNotNull() & (c != "")
    plain = F.trim(F.replace(F.upper(section), F.lit(" SECTION"), F.lit("")))
    return F.array_compact(
        F.array(
            F.when(known(division), F.concat(F.lit("div:"), division)),
            F.when((division == "DATA") & plain.isin(DATA_SECTIONS), F.concat(F.lit("data:"), plain)),
            F.when(known(paragraph), F.concat(F.lit("para:"), paragraph)),
            F.when(known(section) & ~section.eqNullSafe(paragraph), F.concat(F.lit("section:"), section)),
            F.when(known(program), F.concat(F.lit("program:"), program)),
        )
    )


def c_tags(kind: Column, name: Column) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("c_ast:"), kind), F.when(F.length(name) > 0, F.concat(F.lit("fn:"), name))))


def _bracketed(label: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(f"[{label}"), value, F.lit("]")))


def metadata_prefix(*, program: Column, division: Column, section: Column, paragraph: Column, name: Column, start: Column, end: Column, tags: Column, phase: Column | None = None, function: Column | None = None) -> Column:
    """Bracketed context, file name, line range and the first five tags."""
    parts = [_bracketed("phase:", phase)] if phase is not None else []
    parts += [_bracketed("program:", program), _bracketed("", division), _bracketed("section:", section), _bracketed("para:", paragraph)]
    parts += [_bracketed("fn:", function)] if function is not None else []
    lines = F.concat(F.lit("L"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.concat_ws(" ", *parts, name, lines, F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 5))


def retrieval_text(prefix: Column, summary: Column, code: Column) -> Column:
    """Prefix and the summary, or the code where there is no summary."""
    body = F.coalesce(F.nullif(F.trim(summary), F.lit("")), code)
    return F.concat_ws("\n", F.nullif(F.trim(prefix), F.lit("")), body)
