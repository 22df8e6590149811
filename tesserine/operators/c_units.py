"""Functions and structs of C files, by the grammar of declarations.

A file's text is cut into tokens; comments, literals and directives drop out.  The
items of the file are then read one after the other: specifiers, a declarator,
and what follows it.  A unit is a function definition (with a prototype or with
declarations of its parameters before the body, whatever the declarator) or a
struct that is declared by itself; a struct that a typedef, a variable or a
qualifier makes part of a larger declaration is none.  As with a parse of which
only the root's children are looked at, items inside ``#if`` or ``extern "C" { }``
are no units, unless ``inside`` asks for them; a file without units has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import code

TOKEN = re.compile(
    r"(?P<skip>\s+|\\\n|/\*.*?(?:\*/|\Z)|//(?:\\\n|[^\n])*)"
    r"|(?P<directive>^[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*)"
    r"|(?P<literal>(?:L|u8|u|U)?\"(?:\\.|[^\"\\\n])*\"?|(?:L|u|U)?'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<word>[A-Za-z_]\w*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<mark>->|\[\[|\]\]|[^\s\w])",
    re.S | re.M,
)
# Words of the language by what they may do in a declaration.
WITH_ARGUMENT = {"__attribute__", "__attribute", "__declspec", "_Alignas", "alignas", "__asm__", "__asm", "asm", "typeof", "__typeof__"}
QUALIFIERS = {"const", "volatile", "restrict", "static", "extern", "inline", "register", "auto", "typedef", "_Atomic", "_Noreturn", "_Thread_local", "__inline", "__inline__", "__extension__", "__restrict", "__const"}
BASIC_TYPES = {"void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "_Bool", "bool", "_Complex"}
TAGGED = {"struct", "union", "enum"}
CLOSING = {"(": ")", "[": "]", "{": "}", "[[": "]]"}
NOT_BEFORE_CALL = {"->", "."}
BEFORE_CALL = {"return", "else", "do", "case", "goto"}


@dataclass
class Unit:
    kind: str
    name: str | None
    start: int
    end: int
    calls: list[str]
    structs: list[str]


class Reader:
    """The items of one file."""

    def __init__(self, source: str, inside: bool = False):
        self.words: list[str] = []
        self.places: list[tuple[int, int]] = []
        self.names: list[bool] = []
        depth = 0
        for m in TOKEN.finditer(source):
            kind = m.lastgroup
            if kind == "directive":
                what = re.match(r"\s*#\s*(\w*)", m[0])[1]
                depth = max(0, depth + (what in ("if", "ifdef", "ifndef")) - (what == "endif"))
            elif kind != "skip" and (inside or depth == 0):
                self.words.append(m[0])
                self.places.append(m.span())
                self.names.append(kind == "word")
        self.n, self.inside = len(self.words), inside
        self.partner = self._partners()

    def _partners(self) -> list[int]:
        """Of each opening bracket its closing one; what is never closed ends with the file."""
        partner, open_ = [self.n] * self.n, []
        for i, w in enumerate(self.words):
            if w in CLOSING and not self.names[i]:
                open_.append(i)
            elif w in (")", "]", "}", "]]"):
                # A closing brace ends what is open inside its pair.
                fit = next((k for k in range(len(open_) - 1, -1, -1) if CLOSING[self.words[open_[k]]] == w), None)
                if fit is not None and (w == "}" or fit == len(open_) - 1):
                    partner[open_[fit]] = i
                    del open_[fit:]
        return partner

    def word(self, i: int) -> str:
        return self.words[i] if i < self.n else ""

    def after(self, i: int) -> int:
        """The token after the bracket that opens at ``i``."""
        return min(self.n, self.partner[i] + 1)

    def attributes(self, i: int) -> int:
        """The token after attributes and the like at ``i``."""
        while self.word(i) == "[[" or (self.word(i) in WITH_ARGUMENT and self.word(i + 1) == "("):
            i = self.after(i if self.word(i) == "[[" else i + 1)
        return i

    def specifiers(self, i: int) -> tuple[int, list[tuple[str, int, int]]]:
        """The token after the specifiers at ``i``, and they: (word, first token, token after it)."""
        found: list[tuple[str, int, int]] = []
        while i < self.n:
            begin, w = i, self.word(i)
            if (j := self.attributes(i)) > i:
                i, w = j, "attribute"
            elif w in TAGGED:
                i = self.attributes(i + 1)
                if i < self.n and self.names[i]:
                    i += 1
                if self.word(i) == "{":
                    i = self.after(i)
                i = self.attributes(i)
            elif not self.names[i] or self._is_declared(i, any(f[0] != "attribute" for f in found)):
                break
            else:
                i += 1
            found.append((w, begin, i))
        return i, found

    def _is_declared(self, i: int, typed: bool) -> bool:
        """Whether the word at ``i`` is the declarator's name, and no specifier."""
        if self.words[i] in QUALIFIERS or self.words[i] in BASIC_TYPES:
            return False
        follow = self.word(i + 1)
        if follow == "(":  # no parameter begins with a star: it is the declarator that does
            return self.word(i + 2) not in ("*", "^") or typed
        return follow in ("[", ";", ",", "=", ":", ")", "") or follow in WITH_ARGUMENT

    def declarator(self, i: int) -> tuple[int, str | None, bool]:
        """The token after the declarator at ``i``, the name, and whether what has the name is a function."""
        while self.word(i) in ("*", "^") or self.word(i) in QUALIFIERS or self.attributes(i) > i:
            i = max(i + 1, self.attributes(i))
        name, function = None, False
        if self.word(i) == "(" and (self.word(i + 1) in ("*", "^", "(") or (i + 1 < self.n and self.names[i + 1] and self.word(i + 2) in (")", "(", "["))):
            _, name, function = self.declarator(i + 1)
            i = self.after(i)
            inner = True
        elif i < self.n and self.names[i]:
            name, inner, i = self.words[i], False, i + 1
        else:
            return i, None, False
        # A suffix belongs to the name unless a pair of brackets with a pointer is between them.
        first = True
        while self.word(i) in ("(", "["):
            if first and (not inner or (not function and self._bare(name, i))):
                function = self.word(i) == "("
            first, i = False, self.after(i)
        return i, name, function

    def _bare(self, name: str | None, i: int) -> bool:
        """Whether the brackets before ``i`` hold nothing but the name."""
        return name is not None and self.word(i - 1) == ")" and self.word(i - 2) == name and self.word(i - 3) == "("

    def parameter_declarations(self, i: int) -> int | None:
        """The body after declarations of parameters at ``i``, None if they are none."""
        while i < self.n and self.word(i) != "{":
            j, found = self.specifiers(i)
            if not found:
                return None
            while True:
                j, name, _ = self.declarator(j)
                j = self.attributes(j)
                if name is None or self.word(j) not in (",", ";"):
                    return None
                j += 1
                if self.words[j - 1] == ";":
                    break
            i = j
        return i if self.word(i) == "{" else None

    def units(self) -> Iterator[Unit]:
        i = 0
        while i < self.n:
            i = yield from self.item(i)

    def item(self, begin: int) -> Iterator[Unit]:
        """Read the item at ``begin``, yield what is a unit; the token after it."""
        if self.word(begin) == "extern" and self.word(begin + 1).startswith('"'):
            if self.word(begin + 2) == "{":
                return begin + 3 if self.inside else self.after(begin + 2)
            i, found = self.specifiers(begin + 2)
        else:
            i, found = self.specifiers(begin)
        if self.word(i) == ";" and found:
            kinds = [f for f in found if f[0] != "attribute"]
            if len(kinds) == 1 and kinds[0][0] == "struct" and self.words[begin] != "extern":
                yield self.struct(kinds[0][1], i)
            return i + 1
        j, name, function = self.declarator(i)
        j = self.attributes(j)
        if function:
            body = self.parameter_declarations(j)
            if body is not None:
                yield self.function(begin, body, name)
                return self.after(body)
            if not found and j < self.n and (self.names[j] or self.word(j) == "}"):
                # A macro call before the item, or one by itself.
                return j if self.word(j) != "}" else j + 1
        return self.rest(max(i, begin))

    def rest(self, i: int) -> int:
        """The token after the item, which has no body at its end."""
        while i < self.n and self.word(i) != ";":
            if self.word(i) == "}":
                return i + 1
            block = self.word(i) == "{"
            i = self.after(i) if self.word(i) in CLOSING and not self.names[i] else i + 1
            # What comes after a block and is no declarator or initialiser is the next item.
            if block and self.word(i) not in (";", ",", "=", "*") and not (i < self.n and self.names[i] and self.word(i + 1) in (";", ",", "=", "[")):
                return i
        return i + 1

    def function(self, begin: int, body: int, name: str | None) -> Unit:
        end = self.after(body)
        return Unit("function", name, self.places[begin][0], self.places[end - 1][1], self.calls(body, end), self.structs(begin, end))

    def struct(self, begin: int, end: int) -> Unit:
        i = self.attributes(begin + 1)
        name = self.words[i] if self.names[i] else None
        body = next((k for k in range(i, end) if self.words[k] == "{"), end)
        return Unit("struct", name, self.places[begin][0], self.places[end - 1][1], [], self.structs(body, end))

    def calls(self, begin: int, end: int) -> list[str]:
        """Called names, in order and with repetitions. After a name or a type it is declared, after a dot or an arrow a member."""
        found = []
        for k in range(begin + 1, end - 1):
            w, before = self.words[k], self.words[k - 1]
            if not self.names[k] or self.words[k + 1] != "(" or w in code.C_KEYWORDS or w in code.NOT_CALLED or w in WITH_ARGUMENT:
                continue
            if before in NOT_BEFORE_CALL or (self.names[k - 1] and before not in BEFORE_CALL):
                continue
            found.append(w)
        return found

    def structs(self, begin: int, end: int) -> list[str]:
        found = set()
        for k in range(begin, end - 1):
            if self.names[k] and self.words[k] == "struct" and (i := self.attributes(k + 1)) < end and self.names[i]:
                found.add(self.words[i])
        return sorted(found)


def units(source: str, inside: bool = False) -> list[Unit]:
    """The units of one file's text."""
    return list(Reader(source, inside).units())


def c_units(files: DataFrame, inside: bool = False) -> DataFrame:
    """One row a unit of ``files`` (file, text): lines, name, kind, snippet, calls and structs."""
    names = {"file": "string", "start_line": "int", "end_line": "int", "name": "string", "kind": "string", "code_snippet": "string", "calls_functions": "array<string>", "uses_structs": "array<string>"}
    types = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 3, *[pa.list_(pa.string())] * 2]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, source in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                line, at = 1, 0
                for u in units(source or "", inside):
                    line, at = line + source.count("\n", at, u.start), u.start
                    rows.append((file, line, line + source.count("\n", u.start, u.end), u.name, u.kind, source[u.start : u.end], u.calls, u.structs))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))

    return files.select("file", "text").mapInArrow(scan, ", ".join(f"{n} {t}" for n, t in names.items()))


def call_edges(chunks: DataFrame) -> DataFrame:
    """(chunk_id, callee, n) of the call lists of chunks."""
    return chunks.select("chunk_id", F.explode("calls_functions").alias("callee")).groupBy("chunk_id", "callee").agg(F.count(F.lit(1)).alias("n"))
