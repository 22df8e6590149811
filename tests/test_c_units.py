"""The reader of C: snippets with the units that they have."""

import pytest

from tesserine.operators.c_units import c_units, units

CASES = {
    "prototype": ("int f(void) { return g(1); }", [("function", "f", ["g"], [])]),
    "pointer result": ("static const char *name(int k)\n{\n  return names[k];\n}", [("function", "name", [], [])]),
    "old style": ("int add(a, b)\n  int a;\n  long b, *c;\n{ return a + b; }", [("function", "add", [], [])]),
    "old style struct": ("int len(p) struct list *p; { return count(p->next); }", [("function", "len", ["count"], ["list"])]),
    "implicit int": ("main() { run(); }", [("function", "main", ["run"], [])]),
    "function pointer result": ("int (*pick(int k))(void) { return table[k]; }", [("function", "pick", [], [])]),
    "function pointer result of a typedef'd type": ("foo_t (*pick(int k))(int, char) { return 0; }", [("function", "pick", [], [])]),
    "array pointer result": ("int (*row(int k))[4] { return &m[k]; }", [("function", "row", [], [])]),
    "name in brackets": ("int (abs)(int x) { return x < 0 ? -x : x; }", [("function", "abs", [], [])]),
    "attribute before": ("__attribute__((noreturn)) void die(const char *s) { exit(1); }", [("function", "die", ["exit"], [])]),
    "attribute between": ("static void __attribute__((unused, section(\".x\"))) f(void) { }", [("function", "f", [], [])]),
    "standard attribute": ("[[nodiscard]] int f(void) { return 0; }", [("function", "f", [], [])]),
    "declspec": ("__declspec(dllexport) int f(void) { return 0; }", [("function", "f", [], [])]),
    "macro type": ("EXPORT API_TYPE f(int a, ...) { va_start(ap, a); }", [("function", "f", ["va_start"], [])]),
    "result of a struct type": ("struct point mid(struct point a, struct line *l) { return half(a); }", [("function", "mid", ["half"], ["line", "point"])]),
    "result of a struct with a body": ("struct p { int x; } make(void) { struct p q; return q; }", [("function", "make", [], ["p"])]),
    "function pointer parameter": ("void each(int (*f)(int), int n) { while (n--) f(n); (*f)(n); }", [("function", "each", ["f"], [])]),
    "struct": ("struct node { struct node *next; int v; };", [("struct", "node", [], ["node"])]),
    "nameless struct": ("struct { int x; };", [("struct", None, [], [])]),
    "struct declared ahead": ("struct node;", [("struct", "node", [], [])]),
    "packed struct": ("struct __attribute__((packed)) wire { char c; };\nstruct late { int x; } __attribute__((aligned(8)));", [("struct", "wire", [], []), ("struct", "late", [], [])]),
    "typedef'd struct": ("typedef struct node { int v; } node_t;\ntypedef struct { int x; } point, *point_p;", []),
    "struct of variables": ("struct a { int x; } one, *two = &one, three[4];\nstatic struct b { int y; };\nconst struct c d = { 1, f(2) };", []),
    "union, enum, variables": ("union u { int a; };\nenum e { A, B = 2 };\nint x = 1, *y, z[3] = { 1, 2, 3 };\nint (*fp)(int) = 0;\nint g(int);\nextern int h(void), k;", []),
    "braces in literals and comments": ("/* { */ int f(void) { char *s = \"}{\"; // }\n char c = '{'; return g(s); }", [("function", "f", ["g"], [])]),
    "calls": ("void f(void) { int x = sizeof(int); o.m(1); p->m(2); if (a(b(1))) return c(); else d(); int q(int); (e)(1); T v = (T) w(2); }", [("function", "f", ["a", "b", "c", "d", "w"], [])]),
    "conditionals": ("#ifdef X\nint hidden(void) { }\n#else\nint other(void) { }\n#endif\nint seen(void) { }", [("function", "seen", [], [])]),
    "linkage": ('extern "C" { int f(void) { } }\nextern "C" int g(void) { return 1; }', [("function", "g", [], [])]),
    "directives with braces": ("#define OPEN {\\\n  {\nint f(void) { return OPEN_(1); }", [("function", "f", ["OPEN_"], [])]),
    "macro call before a function": ("MODULE_LICENSE(\"x\")\nDEFINE(a, b);\nint f(void) { return 0; }", [("function", "f", [], [])]),
    "one after the other": ("int a(void) { if (1) { } }\nstruct s { int x; };\nint v;\nvoid b(void) { }\n;\nvoid c(void) { }", [("function", "a", [], []), ("struct", "s", [], []), ("function", "b", [], []), ("function", "c", [], [])]),
    "never closed": ("int a(void) { }\nint f(void) { if (x) {", [("function", "a", [], []), ("function", "f", [], [])]),
    "closed too often": ("int a(void) { } }\nint b(void) { }", [("function", "a", [], []), ("function", "b", [], [])]),
    "nested function": ("int a(void) { int inner(void) { return 1; } return inner(); }", [("function", "a", ["inner"], [])]),
    "no C at all": ("Dear all (and you), this is {prose}; with 'odd marks and ends\n", []),
    "empty": (" \n/* nothing */\n", []),
}


@pytest.mark.parametrize("name", CASES)
def test_units(name):
    source, expected = CASES[name]
    assert [(u.kind, u.name, u.calls, u.structs) for u in units(source)] == expected


def test_places_of_units():
    source = "// one\nstatic int *\nf(void)\n{\n}\n\nstruct s {\n int x;\n} __attribute__((packed));\n"
    assert [source[u.start : u.end] for u in units(source)] == ["static int *\nf(void)\n{\n}", "struct s {\n int x;\n} __attribute__((packed))"]
    inside = CASES["conditionals"][0] + "\n" + CASES["linkage"][0]
    assert [u.name for u in units(inside, inside=True)] == ["hidden", "other", "seen", "f", "g"]


def test_units_of_files(spark):
    rows = [("a.c", "\n\nint f(void)\n{\n g(1);\n}\nstruct s;"), ("empty.c", ""), ("null.c", None), ("a.c", "int h(void) { }"), ("long.c", "int x;\n" * 20_000 + "int last(void) { }\n" + "void g(void) { h(); }\n" * 3000)]
    got = [tuple(r) for r in c_units(spark.createDataFrame(rows, "file string, text string")).where("name <> 'g'").orderBy("file", "start_line").collect()]
    assert got == [
        ("a.c", 1, 1, "h", "function", "int h(void) { }", [], []),
        ("a.c", 3, 6, "f", "function", "int f(void)\n{\n g(1);\n}", ["g"], []),
        ("a.c", 7, 7, "s", "struct", "struct s", [], []),
        ("long.c", 20_001, 20_001, "last", "function", "int last(void) { }", [], []),
    ]


def test_query_with_words_of_the_language(spark, tmp_path):
    import duckdb

    from tesserine.plans import catalog

    texts = ["double while prose", "case struct __typeof__ return", "typeof sizeof void", "Else const, goto inline", "plain words only", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    columns = "doc_id, kind, name, start_line, end_line, calls, structs"
    got = sorted(tuple(r) for r in catalog.QUERIES["c_grammar_units"](spark, str(tmp_path)).select(*columns.split(", ")).collect())
    documents = duckdb.read_parquet(f"{tmp_path}/documents.parquet/*.parquet")  # noqa: F841 - the SQL reads it
    assert got == sorted(duckdb.sql(f"SELECT {columns} FROM ({catalog.SQL['c_grammar_units']})").fetchall())
    assert any(r[5] == "double,while,prose,h,h" for r in got)
