"""Expressions over text, paths, tags and ids."""

import hashlib

from pyspark.sql import functions as F

from tesserine.functions import code, ids, paths, tags, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


def test_paths(spark):
    rows = {
        "proj/src/main.c": ("proj/src", "main", "c", "src", "C", "code"),
        "proj/README": ("proj", "README", None, "proj", "TEXT", "code"),
        "proj/doc/a.TXT": ("proj/doc", "a", "txt", "doc", "Text", "docs"),
        "a.po": (".", "a", "po", "a.po", "PO", "docs"),
        "p/.hidden": ("p", ".hidden", None, "p", "TEXT", "code"),
    }
    p = F.col("v")
    df = spark.createDataFrame([(k,) for k in rows], "v string")
    got = df.select("v", paths.directory(p), paths.stem(p), paths.extension(p), paths.folder(p), paths.language(p), paths.source_type(p)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == rows
    assert one(spark, "/data/proj/a/b.c", lambda v: paths.below_root(v, "/data/proj")) == "proj/a/b.c"
    assert one(spark, "first", paths.phase) == "middle-end" and one(spark, "my Lexer emit", paths.phase) == "frontend" and one(spark, "x", paths.phase) == "middle-end"
    assert one(spark, "how to parse a COPY", paths.routed_folder) == "libcob" and one(spark, "zzz", paths.routed_folder) is None
    assert one(spark, "what do the news and readme say", paths.doc_file) == "NEWS" and one(spark, "renewsed", paths.doc_file) is None
    assert not one(spark, "../x", paths.is_safe) and not one(spark, "/x", paths.is_safe) and one(spark, "a/b..c", paths.is_safe)


def test_text(spark):
    assert one(spark, "END-IF a 88-level, X_Y z", text.tokens) == ["end-if", "88-level", "x_y"]
    assert one(spark, "a\nb\nc", lambda v: text.truncate_lines(v, 2)) == "a\nb\n... (1 more lines)"
    assert one(spark, "a\nb", lambda v: text.truncate_lines(v, 0)) == "a\nb"
    assert one(spark, "One.  Two!\nThree? Four.", text.three_sentences) == "One. Two! Three?"
    assert one(spark, "One. Two", text.three_sentences).startswith("One. Two This behavior")
    assert one(spark, None, text.three_sentences) == text.FILL_NONE
    assert one(spark, "x [1] y [2, 9] `z` [0]", lambda v: text.citations(v, F.lit(3))) == [1, 2]
    assert one(spark, "t ```C\nint x;\n``` u", text.code_blocks)[0].asDict() == {"lang": "c", "content": "int x;\n"}
    got = one(spark, '```json\n{"technical_explanation": "See above", "code_snippet": ""}\n```', lambda v: text.extracted_answer(v, F.lit("d"), F.lit("c")))
    assert (got["explanation"], got["code"]) == ("d", "c")
    assert one(spark, "\n".join("x" * 30), text.cut_code).endswith("x\n\n…")
    assert one(spark, "y" * 50, text.preview) == "y" * 45 + "…"


def test_ids_and_embedding(spark):
    args = [F.lit("p"), F.lit(1), F.lit(2)]
    assert one(spark, "s", lambda v: ids.chunk_id(*args, v)) == hashlib.sha256(b"p|1|2\ns").hexdigest()[:32]
    assert one(spark, "s", lambda v: ids.parent_id(*args, v)) == hashlib.sha256(b"p|1|2|s").hexdigest()[:24]
    e = one(spark, "s", ids.pseudo_embedding)
    digest = hashlib.sha256(b"s").digest()
    assert len(e) == 768 and e[32:] == [0.0] * 736 and e[:8] == e[24:32]
    assert abs(e[1] - (int.from_bytes(digest[4:8], "big") * 0.2 / 2**32 - 0.1)) < 1e-12


def test_tags(spark):
    assert one(spark, "identification", tags.role_tags) == ["control_flow"]
    assert one(spark, None, tags.role_tags) == []
    got = one(spark, "WORKING-STORAGE SECTION", lambda v: tags.structural_tags(F.lit("DATA"), v, F.lit(None).cast("string"), F.lit("P")))
    assert got == ["div:DATA", "data:WORKING-STORAGE", "section:WORKING-STORAGE SECTION", "program:P"]
    none = F.lit(None).cast("string")
    prefix = one(spark, "f", lambda v: tags.metadata_prefix(phase=F.lit("ir"), program=none, division=F.lit("DATA"), section=none, paragraph=F.lit("A"), name=v, start=F.lit(1), end=F.lit(2), tags=F.array(*map(F.lit, "abcdef"))))
    assert prefix == "[phase:ir] [DATA] [para:A] f L1-2 a b c d e"
    assert one(spark, "", lambda v: tags.retrieval_text(F.lit(" p "), v, F.lit("code"))) == "p\ncode"


def test_code(spark):
    assert one(spark, '#include "b.h"\n  # include "a.h"\n#include <c.h>\n#include "b.h"', code.include_headers) == ["b.h", "a.h"]
    assert one(spark, "f(g(1)); if (x) sizeof(y)", code.calls) == ["f", "g"]
    tokens = one(spark, '#include <a.h>\n#define MAX 1\n/* SEE-THIS */ run(1)', code.syntax_tokens)
    assert tokens["includes"] == ["a.h"] and tokens["macros"] == ["MAX"] and tokens["functions"] == ["run"] and tokens["comment_refs"] == ["SEE-THIS"]


def test_citations(spark):
    long = "[" + ", ".join(["1"] * 30) + "]"
    found = lambda answer: one(spark, answer, lambda c: text.citations(c, F.lit(3)))
    assert found("see [2], [1, 3] and [4] [0] [x] [1,2 ]" + long + " [2]") == [2, 1, 3, 2]
    assert found("none") == [] and found(None) is None
