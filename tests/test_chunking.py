"""Chunking rules on small literal files."""

import random

import pytest
from pyspark.sql import functions as F

from tesserine.functions import text
from tesserine.operators import chunking
from tesserine.operators.c_units import c_units

PROGRAM = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAYROLL.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 TOTAL PIC 9(5).
       PROCEDURE DIVISION.
       MAIN-PART.
           MOVE 1 TO TOTAL.
           DISPLAY TOTAL
      * A COMMENT LINE WITH A PERIOD.
       LAST-PART.
           STOP RUN."""


def frame(spark, rows, schema="file string, text string"):
    return spark.createDataFrame(rows, schema)


def test_lines(spark):
    cases = {"": [], "a": ["a"], "a\n": ["a"], "a\n\n": ["a", ""], "a\r\nb\x0bc d": ["a", "b", "c", "d"], "\n": [""], "a\r\n": ["a"]}
    rows = frame(spark, [(k, k) for k in cases] + [("null", None)]).select("file", text.lines(F.col("text")).alias("l")).collect()
    assert {r["file"]: r["l"] for r in rows} == {**cases, "null": []}


def test_boundaries(spark):
    cases = {
        "       MAIN-PART.": True,
        "       MAIN.": False,  # nothing behind column 12
        "       WORKING-STORAGE SECTION.": True,
        "       MAIN PROGRAM SECTION.": False,
        "       DATA DIVISION.": False,
        "       01 TOTAL PIC 9(5).": False,
        "           STOP RUN.": True,  # the first column of the next area counts
        "            STOP RUN.": False,
        "      * COMMENT LINE.": False,
        "       NO-PERIOD HERE": False,
        "": False,
    }
    rows = frame(spark, [(k, k) for k in cases]).select("file", chunking.is_paragraph(F.col("text")).alias("b"), chunking.paragraph_name(F.col("text")).alias("n")).collect()
    assert {r["file"]: r["b"] for r in rows} == cases
    assert next(r["n"] for r in rows if "WORKING" in r["file"]) == "WORKING-STORAGE"


def test_divisions_and_program(spark):
    lines = chunking.lines_of(frame(spark, [("a.cbl", PROGRAM), ("b.cbl", "no program"), ("c.cbl", None)]))
    assert [tuple(r) for r in chunking.program_ids(lines).collect()] == [("a.cbl", "PAYROLL")]
    found = lines.select(chunking.division_of(F.col("line")).alias("d")).where("d is not null").collect()
    assert [r["d"] for r in found] == ["IDENTIFICATION", "DATA", "PROCEDURE"]
    assert frame(spark, [("x", "  DATA.  ")]).select(chunking.division_of(F.col("text"))).first()[0] == "DATA"


def reference_chunks(rows, cap):
    """The rules, line by line: (start, end, division, section, name) from (boundary, division, name) of each line."""
    out, division, section = [], None, None
    start, size, name = 1, 0, None
    for n, (boundary, new_division, new_name) in enumerate(rows, 1):
        if new_division:
            division, section = new_division, None
        if boundary or size >= cap:
            if size:
                out.append((start, n - 1, division, section, name))
            start, size, name = n, 1, None
            if boundary:
                name = section = new_name
        else:
            size += 1
    if size:
        out.append((start, len(rows), division, section, name))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_paragraphs_equal_the_rules(spark, seed):
    rng = random.Random(seed)
    data, expected = [], set()
    for f in range(60):
        rows = []
        for n in range(rng.randint(1, 25)):
            boundary, division = rng.random() < 0.2, rng.choice(["DATA", "PROCEDURE"]) if rng.random() < 0.12 else None
            rows.append((boundary, division, f"P{n}"))
            data.append((f"f{f}", n + 1, f"line {n}", boundary, division, f"P{n}"))
        expected |= {(f"f{f}", *c) for c in reference_chunks(rows, 3)}
    lines = spark.createDataFrame(data, "file string, line_no int, line string, b boolean, d string, p string")
    found = chunking.paragraph_chunks(lines, F.col("b"), F.col("d"), F.col("p"), 3)
    got = {tuple(r) for r in found.select("file", "start_line", "end_line", "division", "section_name", "paragraph_name").collect()}
    assert got == expected


def test_fixed_windows_reassemble(spark):
    body = "\n".join(f"l{i}" for i in range(103))
    rows = chunking.fixed_chunks(frame(spark, [("a", body), ("e", ""), ("n", None)]), 45).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in rows] == [(1, 45), (46, 90), (91, 103)]
    assert "\n".join(r["code_snippet"] for r in rows) == body
    with pytest.raises(ValueError):
        chunking.fixed_chunks(frame(spark, [("a", body)]), 5, 5)


C_SOURCE = """#include "a.h"
/* int no(void) { } */
struct point { int x; };
static int helper(int a) { return sizeof(a); }
int main(void)
{
    struct point p;
    if (helper(1)) { puts("} {"); }
    return helper(2);
}
int global = 3;
"""


def test_c_units(spark):
    rows = c_units(frame(spark, [("m.c", C_SOURCE), ("e.c", "int x;"), ("n.c", None)])).orderBy("start_line").collect()
    assert [(r["kind"], r["name"], r["start_line"], r["end_line"]) for r in rows] == [("struct", "point", 3, 3), ("function", "helper", 4, 4), ("function", "main", 5, 10)]
    assert rows[2]["calls_functions"] == ["helper", "puts", "helper"] and rows[2]["uses_structs"] == ["point"]


def test_dispatch(spark):
    files = frame(spark, [("r/a.cbl", PROGRAM), ("r/m.c", C_SOURCE), ("r/x.c", "int x;\n"), ("r/README.md", "one\ntwo"), ("r/long.cob", "\n".join(["just a line"] * 60))])
    rows = chunking.chunk_files(files, window=45).collect()
    by = {}
    for r in rows:
        by.setdefault(r["file"], []).append(r)
    assert len(by["r/m.c"]) == 3 and len(by["r/x.c"]) == 1 and len(by["r/long.cob"]) == 2
    assert {r["language"] for r in by["r/a.cbl"]} == {"COBOL"} and all("program:PAYROLL" in r["tags"] for r in by["r/a.cbl"])
    assert by["r/README.md"][0]["source_type"] == "docs" and by["r/README.md"][0]["tags"] == []
    assert "fn:main" in next(r["tags"] for r in by["r/m.c"] if r["function_name"] == "main")
