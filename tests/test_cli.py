"""The command line, and the search for many strings."""

import json

import pytest
from pyspark.sql import functions as F

from tesserine import cli
from tesserine.operators import needles


def run(capsys, *arguments):
    code = cli.main(list(arguments))
    out = capsys.readouterr().out
    return code, json.loads(out) if out.strip() else None


def test_from_folder_to_report(spark, tmp_path, capsys):
    root = tmp_path / "proj"
    for name, body in {"src/a.c": "int apple(void) { return pear(1); }\n", "src/b.c": "int plum(void) { return 2; }\n", "README": "apples and plums\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    store = str(tmp_path / "store")
    assert run(capsys, "ingest", str(root), "--store", store) == (0, {"files": 3, "chunks": 3})
    assert run(capsys, "status", "--store", store)[1]["point_count"] == 3
    code, found = run(capsys, "query", "--store", store, "--top-k", "2", "apple", "plum")
    assert code == 0 and [x["query"] for x in found] == ["apple", "plum"] and all(0 < len(x["results"]) <= 2 for x in found)
    assert found[1]["results"][0]["file_path"].startswith("proj/")
    (tmp_path / "set.jsonl").write_text('{"query": "plum", "expected_paths": ["proj/src/b.c"], "answer_must_contain": ["two"]}\n')
    (tmp_path / "answers.jsonl").write_text('{"query": "plum", "answer": "It gives two."}\n')
    code, report = run(capsys, "evaluate", str(tmp_path / "set.jsonl"), "--store", store, "--answers", str(tmp_path / "answers.jsonl"))
    assert code == 0 and report["retrieval"]["queries_total"] == 1 and report["answers"]["pass_rate"] == 1.0
    (tmp_path / "none.jsonl").write_text("\n")
    assert cli.main(["evaluate", str(tmp_path / "none.jsonl"), "--store", store]) == 1
    with pytest.raises(SystemExit):
        cli.main(["query", "--store", store])


@pytest.mark.parametrize("most", [200_000, 3])
def test_many_strings(spark, monkeypatch, most):
    monkeypatch.setattr(needles, "MOST_NEEDLES", most)
    texts = spark.createDataFrame([(1, "banana"), (2, "an"), (3, ""), (4, None), (5, "xyz é(b)")], "id long, t string")
    names = spark.createDataFrame([("an",), ("ana",), ("",), (None,), ("é(",), ("an",), ("zz",)], "n string")
    got = sorted((r["id"], r["n"]) for r in needles.holding(texts, "t", names, "n").collect())
    assert got == [(1, ""), (1, "an"), (1, "ana"), (2, ""), (2, "an"), (3, ""), (5, ""), (5, "é(")]
    assert needles.holding(texts, "t", names.where(F.lit(False)), "n").count() == 0
