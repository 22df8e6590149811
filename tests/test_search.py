"""BM25, vectors, fusion and the search plans."""

import math

import pytest
from pyspark.sql import functions as F

from tesserine.operators import bm25, fusion, vectors
from tesserine.plans import context, search
from tesserine.sources.index_store import IndexStore


def test_bm25_formula(spark):
    docs = {1: "red apple red", 2: "green apple", 3: "blue sky blue sea", 4: "", 5: None}
    index = bm25.build_index(spark.createDataFrame(list(docs.items()), "d long, t string"), "d", "t")
    queries = spark.createDataFrame([(7, "red apple red")], "query_id long, text string")
    got = {r["id"]: r["score"] for r in bm25.scores(index, queries).collect()}
    words = {d: t.split() for d, t in docs.items() if t}
    n, avg = len(words), sum(map(len, words.values())) / 3
    df = {w: sum(w in ws for ws in words.values()) for ws in words.values() for w in ws}
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    expected = {}
    for d, ws in words.items():
        s = sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in "red apple red".split() if w in ws)
        if any(w in ws for w in ("red", "apple")):
            expected[d] = round(s, 6)
    assert got == expected


def corpus_of(spark, n, common, seed=0):
    """Documents of rare words, ``common`` of which share one word more."""
    import random

    r = random.Random(seed)
    rows = [(i, " ".join([f"w{int(r.paretovariate(0.7)) % 500}" for _ in range(r.randint(0, 40))] + ["shared"] * (r.randint(1, 3) if i < common else 0))) for i in range(n)]
    return spark.createDataFrame(rows, "d long, t string").repartition(3)


def best(frame, k):
    return [tuple(r) for r in bm25.ranked(frame, k).where("score > 1e-9").select("query_id", "rank", "id", "score").orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("block", [4, 128])
def test_bounded_search_equals_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(bm25, "BLOCK", block)
    docs = corpus_of(spark, 900, 700)
    index = bm25.build_index(docs, "d", "t").persist()
    queries = spark.createDataFrame([(1, "shared"), (2, "shared w1 w499"), (3, "w1 w2 w3 w3 shared"), (4, "w17 w33 w250 w4"), (5, "none of them"), (6, " ".join(f"w{i}" for i in range(60))), (7, "")], "query_id long, text string")
    full = bm25.scores(index, queries)
    for k in (1, 40, 2000):
        assert best(bm25.best_scores(index, queries, k), k) == best(full, k)
    few, all_ = (f.where("query_id = 1").count() for f in (bm25.best_scores(index, queries.where("query_id = 1"), 3), full))
    assert all_ >= 700 and (block > 4 or few < 200)
    monkeypatch.setattr(bm25, "MOST_WEIGHTS", 2)
    assert best(bm25.best_scores(index, queries, 7), 7) == best(full, 7)
    index.unpersist()
    # A word in most documents of a corpus where most words are so: its weight is negative.
    few = bm25.build_index(spark.createDataFrame([(i, "a b c" if i else "a b c d") for i in range(9)], "d long, t string"), "d", "t")
    q = spark.createDataFrame([(1, "a d"), (2, "d b c")], "query_id long, text string")
    assert [tuple(r) for r in bm25.ranked(bm25.best_scores(few, q, 3), 3).orderBy("query_id", "rank").collect()] == [tuple(r) for r in bm25.ranked(bm25.scores(few, q), 3).orderBy("query_id", "rank").collect()]


def shuffled_rows(frame):
    """Rows that the exchanges of an executed plan wrote."""
    frame.collect()
    total, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        for inner in ("executedPlan", "plan"):
            if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec"):
                try:
                    todo.append(getattr(node, inner)())
                    break
                except Exception:  # noqa: BLE001, S112
                    continue
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            total += node.metrics().get("shuffleRecordsWritten").get().value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


def test_rows_shuffled_do_not_grow_with_documents_that_share_a_term(spark):
    queries = spark.createDataFrame([(1, "shared w1"), (2, "w2 shared")], "query_id long, text string")
    rows = []
    for common in (300, 2400):
        index = bm25.build_index(corpus_of(spark, 2500, common), "d", "t").persist()
        index.blocks().count()
        rows.append(shuffled_rows(bm25.search(index, queries, 3)))
        index.unpersist()
    # Four shards hand on nine documents a query, in the first pass and in the second.
    assert max(rows) <= 2 * 2 * 4 * 9 + 60 and abs(rows[1] - rows[0]) < 40, rows


def test_index_of_a_batch_equals_all_scores(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_DOCUMENTS", 7)
    docs = corpus_of(spark, 500, 400).union(spark.createDataFrame([(500, None), (501, "W1 shared w1"), (502, "w1 shared w1"), (503, "--- !")], "d long, t string"))
    queries = spark.createDataFrame([(1, "shared"), (2, "shared w1 w499"), (3, "w1 w2 w3 w3 shared"), (5, "none of them"), (6, " ".join(f"w{i}" for i in range(60))), (7, ""), (8, None)], "query_id long, text string")
    full, batch = bm25.build_index(docs, "d", "t"), bm25.batch_index(docs, "d", "t", queries).persist()
    assert isinstance(batch, bm25.BatchIndex)
    assert sorted(batch.terms.collect()) == sorted(full.terms.collect())
    assert [round(x, 9) for x in batch.stats.first()] == [round(x, 9) for x in full.stats.first()]
    for k in (1, 40, 2000):
        assert best(bm25.best_scores(batch, queries, k), k) == best(bm25.scores(full, queries), k)
    # Texts and postings are not shuffled: nine documents a query of each task, and term counts once, in the index.
    assert shuffled_rows(bm25.search(batch, queries.where("query_id < 3"), 3)) < 200
    with pytest.raises(ValueError, match="without"):
        bm25.search(batch, spark.createDataFrame([(1, "w200 w201")], "query_id long, text string"), 3)
    batch.unpersist()
    monkeypatch.setattr(bm25, "MOST_CELLS", 3)
    assert isinstance(bm25.batch_index(docs, "d", "t", queries), bm25.Bm25Index)
    empty = bm25.batch_index(docs.limit(0), "d", "t", queries)
    assert bm25.search(empty, queries, 3).count() == 0


@pytest.mark.parametrize("form", ["search", "chat"])
def test_texts_are_read_where_they_lie(spark, form):
    # Small payloads would be broadcast by themselves.
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = rows_shuffled_by_size(spark, form)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    # The documentation files' places are shuffled, without the texts.
    assert rows[1] - rows[0] < (100 if form == "search" else 2400), rows


def rows_shuffled_by_size(spark, form):
    queries = spark.createDataFrame([(1, "shared w1", [1.0, 0.0]), (2, "what is in the readme", [0.0, 1.0])], "query_id long, text string, vector array<float>")
    corpus = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, vector array<float>")
    rows = []
    for n in (300, 2400):
        docs = corpus_of(spark, n, 200).select(F.col("d").alias("id"), F.col("t").alias("code_snippet"), F.when(F.col("d") % 50 == 7, "r/README").otherwise("r/x.c").alias("file_path")).persist()
        docs.count()
        index = bm25.batch_index(docs, "id", "code_snippet", queries).persist()
        found = search.hybrid_search(queries, corpus, index, docs) if form == "search" else search.chat(queries, corpus, index, docs)
        joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "LeftSemi" in line]
        assert any("BroadcastHashJoin" in line for line in joins)
        rows.append(shuffled_rows(found))
        docs.unpersist()
        index.unpersist()
    return rows


def test_index_on_disk_equals_one_built_anew(spark, tmp_path):
    import random

    r = random.Random(1)
    kept, docs = IndexStore(spark, str(tmp_path / "i")), {}
    schema = "d long, t string"
    for step in range(12):
        new = {r.randrange(40): " ".join(f"w{r.randrange(15)}" for _ in range(r.randint(0, 12))) or None for _ in range(6)}
        docs |= new
        kept.upsert(spark.createDataFrame(list(new.items()), schema), "d", "t")
        if step in (3, 7):
            void = r.sample(sorted(docs), 3)
            kept.delete(spark.createDataFrame([(i,) for i in void], "id long"))
            docs = {i: t for i, t in docs.items() if i not in void}
        if step not in (0, 4, 7, 11):
            continue
        again, built = kept.read(), bm25.build_index(spark.createDataFrame(list(docs.items()), schema), "d", "t")
        rows = lambda frame, *columns: sorted(tuple(x) for x in frame.select(*columns).collect())
        assert rows(again.postings, "id", "term", "tf", "dl") == rows(built.postings, "id", "term", "tf", "dl")
        assert rows(again.terms, "term", "df") == rows(built.terms, "term", "df")
        assert [round(x, 9) for x in again.stats.first()] == [round(x, 9) for x in built.stats.first()]
        q = spark.createDataFrame([(1, "w1 w2 w14"), (2, "w3")], "query_id long, text string")
        assert rows(bm25.search(again, q, 5), "query_id", "rank", "id", "score") == rows(bm25.search(built, q, 5), "query_id", "rank", "id", "score")
    assert len(kept.versions()) <= IndexStore.MAX_DELTAS + 1
    loaded = kept.current()
    assert loaded is kept.current()
    kept.delete(spark.createDataFrame([(i,) for i in docs], "id long"))
    assert kept.current() is not loaded and kept.current().postings.count() == 0
    assert bm25.search(kept.current(), q, 5).count() == 0
    kept.reset()
    assert kept.versions() == []


def test_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0]), (6, [2.0, 0.0]), (7, [-1.0, 0.0])], "id long, vector array<float>")
    queries = spark.createDataFrame([(9, [3.0, 0.0]), (8, None)], "query_id long, vector array<float>")
    got = [(r["id"], r["score"]) for r in vectors.search(corpus, queries, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (6, 1.0), (3, round(1 / math.sqrt(2), 6))]
    assert vectors.search(corpus, queries.limit(0), 3).count() == 0


def lists(spark):
    vec = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.1, 2), (2, 12, 0.05, 1)], "query_id long, id long, score double, rank int")
    lex = spark.createDataFrame([(1, 11, 5.0, 1), (1, 13, 4.0, 2)], "query_id long, id long, score double, rank int")
    return vec, lex


def test_fusion_and_relaxation(spark):
    vec, lex = lists(spark)
    fused = fusion.rrf(vec, lex)
    rows = {(r["query_id"], r["id"]): r for r in fused.collect()}
    assert abs(rows[1, 11]["score"] - (1 / 62 + 1 / 61)) < 1e-12 and rows[1, 11]["rank"] == 1
    kept = {(r["query_id"], r["id"], r["relaxed"]) for r in fusion.relevant(fused, 10).collect()}
    assert kept == {(1, 10, False), (1, 13, False), (2, 12, True)}


def test_diversity(spark):
    rows = [(1, i, 0.01 * (10 - i), v, i, f) for i, v, f in [(1, None, "a"), (2, 0.5, "b"), (3, 0.9, "a"), (4, 0.8, "a"), (5, None, None)]]
    hits = spark.createDataFrame(rows, "query_id long, id long, score double, vector_score double, rank int, file_path string")
    assert [r["id"] for r in fusion.diverse(hits, 2, 10).orderBy("rank").collect()] == [1, 3, 2, 5]
    assert [r["id"] for r in fusion.diverse(hits, 0, 2).orderBy("rank").collect()] == [1, 2]


def test_rerank(spark):
    q = spark.createDataFrame([(1, "alpha beta")], "query_id long, text string")
    rows = [(1, 1, 0.03, 1, "none"), (1, 2, 0.029, 2, "alpha beta"), (1, 3, 0.028, 3, "alpha")]
    hits = spark.createDataFrame(rows, "query_id long, id long, score double, rank int, code_snippet string")
    assert [r["id"] for r in fusion.reranked(hits, q, 2).orderBy("rank").collect()] == [2, 1, 3]
    assert [r["id"] for r in fusion.reranked(hits.withColumn("score", F.when(F.col("rank") == 1, 0.9).otherwise(0.1)), q, 2).orderBy("rank").collect()] == [1, 2, 3]


def test_plans(spark):
    queries = spark.createDataFrame([(1, "alpha beta gamma", [1.0, 0.0]), (2, "what is in the readme", [0.0, 1.0])], "query_id long, text string, vector array<float>")
    corpus = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, vector array<float>")
    docs = spark.createDataFrame([(i, f"r/{'README' if i == 4 else f'f{i}.c'}", f"alpha doc{i}", ["t"], 1, 3) for i in range(5)], "id long, file_path string, code_snippet string, tags array<string>, start_line int, end_line int")
    index = bm25.build_index(docs, "id", "code_snippet")
    found = search.query(queries, corpus, index, docs)
    assert found.where("query_id = 1").count() == 5
    chat = search.chat(queries, corpus, index, docs).where("query_id = 2").collect()
    assert [r["file_path"] for r in chat] == ["r/README"]
    assert search.prefetch(queries, corpus, index, docs).groupBy("query_id").count().count() == 2
    cached = found.where("query_id = 1").limit(1)
    assert search.ask(queries, corpus, index, docs, cached).where("query_id = 1").count() == 1
    prompts = context.chat_prompts(queries, search.chat(queries, corpus, index, docs), "S").where("query_id = 2").first()["prompt"]
    assert "[1] r/README L1-3\nalpha doc4" in prompts


def test_events(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ("x",)), (2, [], None)], "query_id long, intro_parts array<string>, result struct<text:string>")
    got = {(r["query_id"], r["seq"]): r["event"] for r in context.event_rows(rows).collect()}
    assert [got[1, i] for i in range(5)] == ["intro_chunk", "intro_chunk", "intro_done", "result", "done"] and [got[2, i] for i in range(3)] == ["intro", "result", "done"]
    stream = spark.createDataFrame([("event: a\ndata: 1\n\nevent: b\ndata: 2",)], "s string")
    assert [tuple(e) for e in stream.select(context.parsed_events(F.col("s"))).first()[0]] == [("a", "1"), ("b", "2")]
