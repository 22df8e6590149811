"""Expressions over file paths and what is inferred from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and names.
DOC_EXTENSIONS = ["md", "rst", "txt", "po", "pot", "adoc", "texi", "info"]
TEXT_EXTENSIONS = ["txt", "info", "texi", "rst", "adoc"]
DOC_NAMES = ["thanks", "readme", "authors", "news", "copying", "todo", "changelog", "about-nls", "hacking", "dependencies"]
# Words that name a phase, first match wins.
PHASES = {
    "frontend": ["lexer", "scanner", "token", "parser", "grammar", "parse", "syntax", "yacc", "bison"],
    "middle-end": ["ir", "intermediate", "optimizer", "optim", "ssa", "cfg", "semantic", "analy"],
    "backend": ["backend", "codegen", "emit", "asm", "assembler", "register", "target", "machine", "object"],
}
# Words that route a question to a folder, first match wins.
FOLDER_WORDS = [
    (["copy", "cobol", "cbl", "cob", "evaluate", "perform", "move ", "display", "accept", "file "], "libcob"),
    (["parser", "scanner", "lex", "grammar", "compile", "cobc", "codegen", "tree", "ast", "reserved"], "cobc"),
    (["config", "option", "flag", "cli", "main "], "cobc"),
    (["intrinsic", "builtin", "call ", "runtime"], "libcob"),
]
# Languages that can be shown.
SHOWN = ["plaintext", "cobol", "c", "cpp", "bash", "sh", "python", "javascript", "json", "xml", "html", "css", "sql", "yaml", "ini", "markdown", "diff", "makefile"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; null if there is none (a leading dot starts no extension)."""
    return F.nullif(F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1)), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def folder(path: Column) -> Column:
    """The part below the root, or the root for files right in it."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise(F.element_at(parts, 1))


def below_root(path: Column, root: str) -> Column:
    """``<name of the root>/<path below it>``, with forward slashes; other paths stay. A scheme counts on neither side."""
    plain_root = re.sub(r"^[a-z][a-z0-9+.-]*:/*(?=/)", "", root.replace("\\", "/")).rstrip("/")
    name = plain_root.rsplit("/", 1)[-1]
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^[a-z][a-z0-9+.-]*:/*(?=/)", "")
    return F.when(plain.startswith(plain_root + "/"), F.concat(F.lit(name), F.substring(plain, len(plain_root) + 1, 1 << 30))).otherwise(plain)


def language(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin("cob", "cbl"), "COBOL").when(ext == "c", "C").when(ext == "h", "C Header").when(ext == "md", "Markdown")
        .when(ext.isin(TEXT_EXTENSIONS), "Text").when(ext.isNull(), "TEXT").otherwise(F.upper(ext))
    )


def source_type(path: Column) -> Column:
    return F.when(extension(path).isin(DOC_EXTENSIONS), "docs").otherwise("code")


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def phase(haystack: Column) -> Column:
    """Phase by the first of the word lists that has a word in the lower-cased text."""
    low, out = F.lower(haystack), F.when(F.lit(False), "")
    for name, words in PHASES.items():
        out = out.when(contains_any(low, words), name)
    return out.otherwise("middle-end")


def phase_haystack(path: Column, function: Column, paragraph: Column, tags: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws(" ", F.coalesce(path, empty), F.coalesce(function, empty), F.coalesce(paragraph, empty), F.coalesce(F.array_join(tags, " "), empty))


def routed_folder(question: Column) -> Column:
    """Folder that a question is about; null if none."""
    low, out = F.trim(F.lower(question)), F.when(F.lit(False), "")
    for words, name in FOLDER_WORDS:
        out = out.when(contains_any(low, words), name)
    return out


def doc_file(question: Column) -> Column:
    """Upper-case name of the leftmost documentation file named as a word; null if none."""
    found = F.regexp_extract(F.lower(question), rf"\b({'|'.join(DOC_NAMES)})\b", 1)
    return F.nullif(F.upper(found), F.lit(""))


def is_safe(path: Column) -> Column:
    """A relative path without steps upwards."""
    return ~(path.startswith("/") | path.rlike(r"^[A-Za-z]:") | F.array_contains(F.split(F.regexp_replace(path, r"\\", "/"), "/"), ".."))


def shown_language(path: Column, lang: Column) -> Column:
    """Language for display, by extension, then by the stored name."""
    low = F.lower(F.coalesce(path, F.lit("")))
    ext, name = F.substring_index(low, ".", -1), F.regexp_replace(F.lower(lang), r"\s+", "")
    return (
        F.when(ext.isin("cob", "cbl"), "cobol").when(ext.isin("c", "h"), "c").when(ext.isin("sh", "bash", "ac", "in", "m4", "am") | low.contains("configure"), "bash")
        .when(ext.isin("at", "conf", "cfg"), "plaintext").when(name.isin(SHOWN), name).when(name == "cheader", "c").otherwise("plaintext")
    )
