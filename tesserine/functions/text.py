"""Text expressions: all are plain Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a line besides CR, LF and CR LF.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
# Sentences that fill up a summary.
FILL_ONE = " It defines how data flows through the compiler pipeline. It is important for phase-correct code generation."
FILL_TWO = " This behavior is relevant to compiler execution."
# The sentences of a summary that is made without a provider.
FOCUS_C, FOCUS_OTHER = "COBOL runtime/compiler support logic", "COBOL statements"
SUMMARY_FLOW = "It consumes intermediate compiler state and emits transformed state or artifacts used by downstream stages. "
NO_HEADERS, NO_NAME = "no direct local headers", "this block"
FILL_NONE = "This block handles COBOL-related compiler behavior. It transforms or routes data through the compiler pipeline. It is relevant to phase-specific execution."


def lines(text: Column) -> Column:
    """Array of the lines of a text; a line end at the very end adds none, an empty text has none.

    Texts with no other line end than LF, the common case, are cut without a regular expression.
    """
    known = F.coalesce(text, F.lit(""))
    body = F.when(known.endswith("\n"), F.substr(known, F.lit(1), F.length(known) - 1)).otherwise(known)
    odd = F.regexp_replace(known, f"(?:{LINE_END})\\z", "")
    return (
        F.when(F.length(known) == 0, F.array().cast("array<string>"))
        .when(known.rlike("[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), F.split(odd, LINE_END, -1))
        .otherwise(F.split(body, "\n", -1))
    )


def tokens(text: Column) -> Column:
    """Search terms: lower-case runs of letters, digits, ``_`` and ``-`` of two characters or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_-]+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 2)


def truncate_lines(snippet: Column, most: int) -> Column:
    """First ``most`` lines and a note on how many were left out; 0 turns it off."""
    if most <= 0:
        return snippet
    parts = F.split(snippet, "\n", -1)
    note = F.concat(F.array_join(F.slice(parts, 1, most), "\n"), F.lit("\n... ("), (F.size(parts) - most).cast("string"), F.lit(" more lines)"))
    return F.when(F.size(parts) > most, note).otherwise(snippet)


def squeeze(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def three_sentences(text: Column) -> Column:
    """Exactly three sentences: the first three, or what there is and fixed ones."""
    parts = F.filter(F.split(squeeze(text), r"(?<=[.!?])\s+"), lambda p: F.length(p) > 0)
    n = F.size(parts)
    return (
        F.when(n >= 3, F.array_join(F.slice(parts, 1, 3), " "))
        .when(n == 2, F.concat(F.array_join(parts, " "), F.lit(FILL_TWO)))
        .when(n == 1, F.concat(F.element_at(parts, 1), F.lit(FILL_ONE)))
        .otherwise(F.lit(FILL_NONE))
    )


def heuristic_summary(name: Column, phase: Column, headers: Column, ext: Column) -> Column:
    """Three sentences on a block from what is known of it."""
    focus = F.when(F.lower(ext).isin("c", "h", "cpp", "hpp"), FOCUS_C).otherwise(FOCUS_OTHER)
    known = F.when(F.size(F.coalesce(headers, F.array().cast("array<string>"))) > 0, F.array_join(F.slice(headers, 1, 3), ", ")).otherwise(NO_HEADERS)
    return F.concat(
        F.lit("This block ("), F.coalesce(F.nullif(name, F.lit("")), F.lit(NO_NAME)), F.lit(") likely handles "), focus,
        F.lit(" in the "), F.coalesce(F.nullif(phase, F.lit("")), F.lit("unknown")), F.lit(" phase. "),
        F.lit(SUMMARY_FLOW),
        F.lit("It coordinates with "), known, F.lit(" to preserve phase-specific behavior."),
    )


def summary_prompt(phase: Column, language: Column, path: Column, name: Column, headers: Column, snippet: Column) -> Column:
    """Input for a summary provider."""
    known = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    return F.concat(
        F.lit("Summarise this block for retrieval in exactly three sentences: what it handles, its input and output, its effect.\n\nPhase: "), known(phase, "unknown"),
        F.lit("\nLanguage: "), known(language, "unknown"), F.lit("\nFile: "), known(path, ""), F.lit("\nFunction: "), known(name, "unknown"),
        F.lit("\nDependencies: "), known(F.array_join(headers, ", "), "none"), F.lit("\n\nCode block:\n"), F.substring(snippet, 1, 5000),
    )


def preview(text: Column, most: int = 45) -> Column:
    """First characters and an ellipsis if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def cut_code(snippet: Column, most: int = 25) -> Column:
    """At most so many lines of code, with an ellipsis paragraph if it is longer."""
    parts = F.split(snippet, "\n", -1)
    return F.when(F.size(parts) - 1 > most, F.concat(F.array_join(F.slice(parts, 1, most), "\n"), F.lit("\n\n…"))).otherwise(snippet)


def strip_fence(answer: Column) -> Column:
    """What is inside a fenced block, if there is one."""
    body = F.when(answer.contains("```json"), F.substring_index(answer, "```json", -1)).otherwise(answer)
    return F.trim(F.regexp_replace(F.regexp_replace(body, "^(?s).*?```", ""), "```", ""))


def extracted_answer(answer: Column, default_text: Column, default_code: Column) -> Column:
    """Explanation and code of a provider's JSON answer, within their caps."""
    parsed = F.from_json(strip_fence(answer), "technical_explanation string, code_snippet string")
    text = F.trim(F.substring(parsed["technical_explanation"], 1, 500))
    empty = text.isNull() | (text == "") | F.lower(text).contains("see context above") | F.lower(text).contains("see above")
    code = F.coalesce(F.nullif(F.trim(F.substring(parsed["code_snippet"], 1, 2000)), F.lit("")), default_code)
    return F.struct(F.when(empty, default_text).otherwise(text).alias("explanation"), cut_code(code).alias("code"))


def assembled_answer(intro: Column, explanation: Column, code: Column) -> Column:
    """Intro, explanation and a code fence, those that there are."""
    fence = F.when(F.length(F.trim(code)) > 0, F.concat(F.lit("```\n"), cut_code(code), F.lit("\n```")))
    return F.concat_ws("\n\n", F.nullif(intro, F.lit("")), F.nullif(explanation, F.lit("")), fence)


# Citations are numbers in brackets, of at most so many characters.
CITATION, LONGEST_CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]", 60


def citations(answer: Column, n_results: Column) -> Column:
    """Numbers in brackets (also lists of them) that name one of the results, in order of appearance."""
    groups = F.filter(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda g: F.length(g) <= LONGEST_CITATION)
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x).try_cast("int"))))
    return F.filter(numbers, lambda x: x.isNotNull() & (x >= 1) & (x <= n_results))


def code_blocks(answer: Column) -> Column:
    """Language and content of each fenced block of an answer."""
    found = F.regexp_extract_all(answer, F.lit(r"(?s)```(\w*)\n?(.*?)```"), F.lit(0))
    return F.transform(
        found,
        lambda b: F.struct(
            F.lower(F.coalesce(F.nullif(F.regexp_extract(b, r"(?s)```(\w*)\n?(.*?)```", 1), F.lit("")), F.lit("plaintext"))).alias("lang"),
            F.regexp_extract(b, r"(?s)```(\w*)\n?(.*?)```", 2).alias("content"),
        ),
    )
