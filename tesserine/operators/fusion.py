"""Fusion of ranked lists, score filters, per-file diversity and reranking."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.config import DEFAULTS

#: Calls of a scorer that run side by side in a task.
SCORERS = 4


def rrf(vector: DataFrame, lexical: DataFrame, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Reciprocal-rank fusion of two lists: query_id, id, score, vector_score and rank.

    Ties go to the vector list's order, then to the lexical one's.
    """
    parts = vector.select("query_id", "id", F.col("score").alias("vs"), F.col("rank").alias("vr"), F.lit(None).cast("int").alias("lr")).unionByName(
        lexical.select("query_id", "id", F.lit(None).cast("double").alias("vs"), F.lit(None).cast("int").alias("vr"), F.col("rank").alias("lr"))
    )
    fused = parts.groupBy("query_id", "id").agg(F.max("vs").alias("vector_score"), F.max("vr").alias("vector_rank"), F.max("lr").alias("lexical_rank"))
    share = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    fused = fused.withColumn("score", share("vector_rank") + share("lexical_rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), "lexical_rank")
    return fused.withColumn("rank", F.row_number().over(order))


def relevant(fused: DataFrame, final_k: int, least: float = DEFAULTS.min_vector_score) -> DataFrame:
    """Hits whose known cosine reaches ``least``; for a query that would be left without any, those of 0 or more.

    Adds ``relaxed`` and renumbers ``rank``; at most ``final_k`` a query.
    """
    whole = Window.partitionBy("query_id")
    good = F.col("vector_score").isNull() | (F.col("vector_score") >= least)
    some = F.max(good.cast("int")).over(whole) == 1
    passed = F.when(some, good).otherwise(F.col("vector_score").isNull() | (F.col("vector_score") >= 0))
    kept = fused.withColumn("relaxed", ~some).withColumn("__passed", passed).where("__passed").drop("__passed")
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= final_k)


def diverse(hits: DataFrame, max_per_file: int = DEFAULTS.max_per_file, final_k: int = DEFAULTS.query_final, file: str = "file_path") -> DataFrame:
    """At most so many hits a file, files by their best score (cosine where known), ties by first appearance."""
    if max_per_file <= 0:
        return hits.where(F.col("rank") <= final_k)
    per_file = Window.partitionBy("query_id", file)
    name = F.coalesce(F.col(file).cast("string"), F.lit(""))
    ranked = hits.withColumn(file, name).withColumns(
        {
            "__best": F.max(F.coalesce("vector_score", "score", F.lit(0.0))).over(per_file),
            "__first": F.min("rank").over(per_file),
            "__nth": F.row_number().over(per_file.orderBy("rank")),
        }
    )
    order = Window.partitionBy("query_id").orderBy(F.col("__best").desc(), "__first", "__nth")
    return ranked.where(F.col("__nth") <= max_per_file).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= final_k).drop("__best", "__first", "__nth")


def overlap_score(query: Column, snippet: Column) -> Column:
    """Default relevance for reranking: the share of the query's terms that the snippet has."""
    from tesserine.functions.text import tokens

    terms = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(terms, tokens(snippet))) / F.greatest(F.size(terms), F.lit(1))


def overlap_batch(queries: list[str], snippets: list[str]) -> list[float]:
    """``overlap_score`` of pairs, as a scorer of ``reranked_in_time``."""
    import re

    words = lambda t: {w for w in re.findall(r"[a-z0-9_-]+", t.lower()) if len(w) >= 2}
    return [len(words(q) & words(s)) / max(1, len(words(q))) for q, s in zip(queries, snippets, strict=True)]


def reranked_in_time(hits: DataFrame, queries: DataFrame, scorer: Callable[[list[str], list[str]], list[float]] = overlap_batch, budget_ms: int = DEFAULTS.rerank_timeout_ms, most: int = DEFAULTS.rerank_max, gap: float = DEFAULTS.rerank_gap, pairs: int = 2) -> DataFrame:
    """``reranked`` with a time budget a query; ``reranked`` (boolean) says which queries were scored in full.

    ``scorer`` (a model, a service) gets (texts, snippets), ``pairs`` at a time, in
    the task that holds the query's first hits.  A query whose scores are not all
    there when its budget ends keeps the fused order, as does one for which the
    scorer fails; so do those that are skipped because the first is well ahead.  A
    call that is under way when time ends is left behind, and not waited for.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    first = hits.where(F.col("rank") <= F.lit(max(most, 2))).withColumn("__lead", F.col("score") - F.lead("score").over(order))
    asked = first.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.coalesce(F.col("__lead") >= gap, F.lit(False)))).alias("skip"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", F.coalesce("code_snippet", F.lit("")).alias("snippet"))))).alias("top"),
    )
    asked = asked.where(~F.coalesce("skip", F.lit(False))).join(queries.select("query_id", "text"), "query_id").select("query_id", F.coalesce("text", F.lit("")).alias("text"), "top")
    name = hits.schema["query_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(SCORERS)
        for batch in batches:
            rows = []
            for query, text, top in zip(*(batch.column(c).to_pylist() for c in ("query_id", "text", "top")), strict=True):
                end, found = time.monotonic() + budget_ms / 1000, []
                calls = [pool.submit(scorer, [text] * len(some), some) for some in ([t["snippet"] for t in top[k : k + pairs]] for k in range(0, len(top), pairs))]
                try:
                    for call in calls:
                        found += call.result(max(0.0, end - time.monotonic()))
                except Exception:  # noqa: BLE001 - late or failed: the fused order stays
                    for call in calls:
                        call.cancel()
                    if any(call.running() for call in calls):
                        pool.shutdown(wait=False)
                        pool = ThreadPoolExecutor(SCORERS)
                    continue
                rows += [(query, t["rank"], float(s)) for t, s in zip(top, found, strict=True)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column("query_id").type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], ["query_id", "rank", "rerank_score"])
        pool.shutdown(wait=False)

    scored = asked.mapInArrow(score, f"query_id {name}, rank int, rerank_score double")
    new = Window.partitionBy("query_id").orderBy(F.col("rank") > most, F.col("rerank_score").desc_nulls_last(), "rank")
    done = F.max(F.col("rerank_score").isNotNull()).over(Window.partitionBy("query_id"))
    return hits.join(scored, ["query_id", "rank"], "left").withColumn("reranked", done).withColumn("rank", F.row_number().over(new))


def reranked(hits: DataFrame, queries: DataFrame, most: int = DEFAULTS.rerank_max, gap: float = DEFAULTS.rerank_gap, score: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """The first ``most`` hits of a query by a second score, the rest after them in their order.

    Skipped for a query whose first score is ahead by ``gap`` or more; ``score``
    makes a column of the query's text and the snippet, for instance by a
    vectorised function over a model.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    lead = hits.withColumn("__gap", F.when(F.col("rank") == 1, F.col("score") - F.lead("score").over(order)))
    skip = F.coalesce(F.max("__gap").over(Window.partitionBy("query_id")) >= gap, F.lit(False))
    scored = lead.withColumn("__skip", skip).join(queries.select("query_id", F.col("text").alias("__query")), "query_id")
    value = F.when(~F.col("__skip") & (F.col("rank") <= most), score(F.col("__query"), F.coalesce("code_snippet", F.lit(""))))
    new = Window.partitionBy("query_id").orderBy(F.col("rank") > most, F.col("rerank_score").desc_nulls_last(), "rank")
    return scored.withColumn("rerank_score", value).withColumn("rank", F.row_number().over(new)).drop("__gap", "__skip", "__query")
