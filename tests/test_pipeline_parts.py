"""Sources, stores, ingestion, file views, metrics, logs and streams."""

import hashlib
import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserine.functions import ids, tags
from tesserine.operators import batching, embedding, evals, files, logs, needles, prefetch
from tesserine.plans import catalog, evaluate
from tesserine.plans.ingest import ingest, reingest, status
from tesserine.sources import discovery
from tesserine.sources.index_store import IndexStore
from tesserine.sources.store import ChunkStore, last_write_wins
from tesserine.streaming import ingest as streamed
from tesserine.streaming import prefetch as stream_prefetch


def tree(root):
    for name, body in {"src/a.c": b"int f(void) { return g(1); }\n", "README": b"read me\n", "x.sln": b"no", ".git/h.c": b"no", "bin.c": b"a\0b", "empty.c": b"", "latin.txt": b"caf\xe9 text\n", "p.cbl": b"       MAIN-PART.\n           STOP RUN.\n"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return str(root)


def test_discovery(spark, tmp_path):
    root = tree(tmp_path / "proj")
    found = {r["file"] for r in discovery.discover(spark, root).collect()}
    # Empty files, which have no chunks anyway, are left out.
    assert found == {"proj/src/a.c", "proj/README", "proj/latin.txt", "proj/p.cbl"}
    assert {r["file"] for r in discovery.discover(spark, root, ["c"]).collect()} == {"proj/src/a.c", "proj/README"}
    assert discovery.extension_list(" .C, h ") == ["c", "h"] and discovery.extension_list("*") is None and discovery.extension_list(None) is None
    first = discovery.read_text(discovery.discover(spark, root), 1).collect()
    assert [r["file"] for r in first] == ["proj/README"]
    assert "Exchange" not in discovery.discover(spark, root)._jdf.queryExecution().executedPlan().toString()


def test_ingest_twice(spark, tmp_path):
    root, out = tree(tmp_path / "proj"), str(tmp_path / "store")
    first = ingest(spark, root, out)
    store = ChunkStore(spark, f"{out}/chunks")
    rows = store.read().count()
    assert first[0] == 4 and first[1] == rows
    assert ingest(spark, root, out) == first and store.read().count() == rows
    assert store.read().where("summary_text is null or size(vector) <> 768").count() == 0
    assert store.tags().count() > 0 and json.loads(store.json_rows(1)[0])["file_path"].startswith("proj/")
    assert status(spark, out)["point_count"] == rows
    assert ingest(spark, root, out, extensions="c", reset=True)[0] == 2
    report = reingest(spark, root, out)
    assert (report["files_ingested"], report["total_chunks"], report["code_root"]) == (4, rows, root)
    with pytest.raises(ValueError):
        reingest(spark, str(tmp_path / "nowhere"), out)


def test_paths_below_the_root(spark, tmp_path):
    root = tmp_path / "outer" / "proj"
    for name in ("top.txt", "src/a.txt", "src/lib/deep/b.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"some text of {name}\n")
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"))
    ingest(spark, str(root), str(tmp_path / "batch"), cache=cache)
    streamed.ingest_stream(streamed.source_files(spark, str(root)), str(tmp_path / "stream"), str(tmp_path / "cp"), cache=cache)
    stores = [ChunkStore(spark, str(tmp_path / k / "chunks")).read() for k in ("batch", "stream")]
    places = {tuple(r) for r in stores[0].select("file_path", "file_dir", "folder", "file_name").collect()}
    assert places == {("proj/top.txt", "proj", "proj", "top"), ("proj/src/a.txt", "proj/src", "src", "a"), ("proj/src/lib/deep/b.txt", "proj/src/lib/deep", "src", "b")}
    ids = [{r["chunk_id"] for r in s.collect()} for s in stores]
    assert ids[0] == ids[1] and cache.read().count() == 3
    index = IndexStore(spark, str(tmp_path / "stream" / "index")).current()
    assert index is IndexStore(spark, str(tmp_path / "stream" / "index")).current() and index.stats.first()["n"] == 3


def test_store_of_many_upserts(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.ensure("chunk_id string, v long")
    want = {}
    for n in range(12):
        rows = [(f"k{k}", n) for k in range(n % 4, 6)]
        want.update(rows)
        assert store.upsert(spark.createDataFrame(rows, "chunk_id string, v long")) == len(rows)
        assert {r["chunk_id"]: r["v"] for r in store.read().collect()} == want
    assert len(store._versions()) <= ChunkStore.MAX_DELTAS


def test_cooldown_with_folders(spark):
    start = datetime(2024, 1, 1)
    rows = [("q", t, f) for t, f in [(0, "a"), (5, "a"), (6, "b"), (14, "a"), (30, "b"), (130, "a"), (131, "b"), (260, "b")]] + [("r", 7, None), ("r", 8, None)]
    events = spark.createDataFrame([(q, start + timedelta(seconds=t), f) for q, t, f in rows], "q string, ts timestamp, folder string")
    got = {(r["q"], r["folder"], r["accepted_us"] // 1_000_000 % 86400) for r in prefetch.accepted(events, "q", "ts", 15, "folder", 120).collect()}
    # 6 b has no answer yet; 14 a has one of 0; 131 b has one of 30; at 260 all is late.
    assert got == {("q", "a", 0), ("q", "b", 6), ("q", "b", 30), ("q", "a", 130), ("q", "b", 260), ("r", None, 7)}


def test_evaluation_report(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"query": "one", "expected_paths": ["a", "b"]}\n\n{"query": " ", "expected_paths": ["a"]}\n{"query": "two", "expected_paths": ["c"], "answer_must_contain": ["Yes"]}\n')
    rows = discovery.eval_rows(spark, str(tmp_path / "e.jsonl"))
    run = lambda q: q.select("query_id", F.when(F.col("text") == "one", "a").otherwise("x").alias("path"), F.lit(2).alias("rank"), F.length("text").cast("double").alias("ms"))
    report = evaluate.retrieval_report(rows, run, 10).first()
    assert (report["queries_total"], report["queries_scored"], report["hit_rate_at_k"], report["recall_at_k"], report["mrr"], report["latency_ms_avg"]) == (2, 2, 0.5, 0.25, 0.25, 3.0)
    answers = evaluate.numbered(rows).select("query_id", F.lit("oh yes").alias("answer"))
    assert tuple(evaluate.answer_report(rows, answers).first()) == (1, 1.0)


def test_catalogue_and_usage(spark):
    assert tags.tag_catalogue(spark).groupBy("kind").count().count() == 2
    rows = spark.createDataFrame([('{"usage_metadata": {"prompt_token_count": 3, "candidatesTokenCount": "4"}}',), ('{"usage_metadata": {"prompt_token_count": "x"}}',), (None,)], "r string")
    assert [tuple(r) for r in rows.select(*logs.usage_tokens(F.col("r"))).collect()] == [(3, 4), (None, None), (None, None)]
    key = rows.limit(1).select(ids.cache_id(F.lit("p"), F.lit(1), F.lit(2), F.lit("s"))).first()[0]
    assert key == hashlib.sha256(b"p|1|2|s").hexdigest()


def test_last_write_wins(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 1, None)], "k long, t long, v string")
    assert {tuple(r) for r in last_write_wins(rows, "k", [F.col("t")]).collect()} == {(1, 3, "b"), (2, 1, None)}


def test_file_views(spark):
    chunks = spark.createDataFrame([("f", 1, 3, "a\nb\nc"), ("f", 3, 4, "C\nd"), ("f", 6, 6, "g")], "file_path string, start_line int, end_line int, code_snippet string")
    assert files.full_files(chunks).first()["text"] == "a\nb\nC\nd\n\ng"
    assert files.line_ranges(chunks, F.lit(2), F.lit(9)).first()["text"] == "b\nc\nd\ng"
    source = spark.createDataFrame([("f", "a\nb\nc")], "file string, text string")
    assert files.file_range(source, "f", 2, 9).first()["text"] == "b\nc" and files.file_range(source, "f", 3, 2).first()["text"] == ""


def test_metrics(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "z", 1)], "query_id long, path string, rank int")
    want = spark.createDataFrame([(1, "b"), (1, "c"), (2, "q")], "query_id long, path string")
    rows = {r["query_id"]: (r["recall"], r["hit"], r["rr"]) for r in evals.query_metrics(run, want, 10).collect()}
    assert rows == {1: (0.5, 1, 0.5), 2: (0.0, 0, 0.0)}
    values = spark.createDataFrame([("t", float(v)) for v in range(1, 12)] + [("u", 5.0)], "g string, v double")
    got = {r["g"]: (r["p50"], r["p95"]) for r in evals.percentiles(values, "g", "v", [50, 95]).collect()}
    assert got == {"t": (6.0, 11.0), "u": (5.0, 5.0)}


def test_names_and_passages_of_any_number(spark, tmp_path):
    chunks = spark.createDataFrame([("r/README", 1, "a"), ("r/README", 9, "b"), ("r/x.c", 1, "c")], "file_path string, start_line int, chunk_id string")
    wanted = spark.range(10_050).select(F.col("id").alias("query_id"), F.when(F.col("id") < 10_020, "readme").when(F.col("id") < 10_040, F.concat(F.lit("no"), "id")).alias("name"))
    got = files.doc_chunks(chunks, wanted, 1).groupBy("chunk_id", "rank").agg(F.countDistinct("query_id").alias("n")).collect()
    assert [tuple(r) for r in got] == [("a", 1, 10_020)]
    assert files.doc_chunks(chunks, wanted.where("name is null"), 1).count() == 0
    spark.createDataFrame([(1, "one passage of w7 words"), (2, "other text w10049 here"), (3, None), *((i, f"filler{i}") for i in range(4, 12))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(10_050).select(F.col("id").alias("item_id"), F.concat(F.lit("w"), F.col("id"), F.lit(" ")).alias("text")).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    row = catalog.QUERIES["retrieval_eval"](spark, str(tmp_path)).first()
    assert (row["queries_scored"], row["hit_rate_at_k"], row["recall_at_k"], row["mrr"]) == (2, 1.0, 1.0, 1.0)


def test_passages_are_looked_for_where_texts_lie(spark, monkeypatch):
    long = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, long.replace("five", "5")), (3, None), (4, f"{long}{long} tail a b"), (5, "tail a b")], "path long, text string")
    passages = spark.createDataFrame([(7, long), (8, "tail a"), (9, "never seen at all in any of these texts"), (10, None), (11, long)], "query_id long, passage string")
    found = evals.holders(docs, passages)
    assert "Exchange hashpartitioning(__run" not in found._jdf.queryExecution().toString() and "explode(" not in found._jdf.queryExecution().toString()
    expected = {(7, 1), (7, 4), (8, 4), (8, 5), (11, 1), (11, 4)}
    assert {tuple(r) for r in found.collect()} == expected
    monkeypatch.setattr(needles, "MOST_NEEDLES", 1)
    assert {tuple(r) for r in evals.holders(docs, passages).collect()} == expected


def test_logs(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"type":"ask","total_ms":2.5,"ts":10}\nnot json\n{"type":"ask","total_ms":3.5,"embed_ms":1.0,"ts":11.5}\n')
    rows = discovery.request_logs(spark, str(path))
    assert rows.count() == 2
    assert sorted(r["value"] for r in logs.entry_json(rows.drop("time")).collect())[0] == '{"type":"ask","total_ms":2.0,"ts":10.0}'
    assert logs.recent(rows, "ts", "type", 1).first()["ts"] == 11.5
    q = streamed.start_log_sink(streamed.log_stream(spark, str(tmp_path / "log*")).drop("time"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_batches_and_cache(spark):
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate([10, 10, 25, 5, 5])], "k string, o int, t long")
    assert [r["batch"] for r in batching.requests(rows, ["k"], "o", "t", 20).orderBy("o").collect()] == [0, 0, 1, 2, 2]
    texts = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    full, added = embedding.embed(texts)
    assert full.count() == 3 and added.count() == 2
    assert embedding.embed(texts, added)[1].count() == 0


def events(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(seconds=s), i) for i, s in enumerate([0, 1, 10, 15, 16, 40])] + [(2, start, 9)]
    return spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")


def test_prefetch_rules(spark):
    rows = events(spark)
    fired = {r["event_id"] for r in prefetch.debounced(rows, "user_id", "ts", "event_id").collect()}
    assert fired == {1, 2, 4, 5, 9}
    taken = Counter(r["user_id"] for r in prefetch.accepted(rows, "user_id", "ts").collect())
    assert taken == {1: 3, 2: 1}
    hits = {r["event_id"]: r["hit"] for r in prefetch.cached(rows, "user_id", "ts", "event_id", F.col("event_id") == 0, 15).collect()}
    assert hits == {1: True, 2: True, 3: True, 4: False, 5: False, 9: False}


def test_streaming_twins(spark, tmp_path):
    # An event far ahead lets the others pass the watermark.
    rows = events(spark).unionByName(spark.createDataFrame([(3, datetime(2024, 1, 2), 10)], "user_id long, ts timestamp, event_id long"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_prefetch.accepted(stream, "user_id", "ts").writeStream.format("memory").queryName("accepted_now").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("accepted_now").where("user_id = 1").count() == 3
    q = stream_prefetch.debounced(stream, "user_id", "ts").writeStream.format("memory").queryName("debounced_now").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("debounced_now").count() >= 3
