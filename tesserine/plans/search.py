"""Batched hybrid search: one plan for one query or ten thousand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.config import DEFAULTS, Settings
from tesserine.functions import paths, text
from tesserine.operators import bm25, fusion, vectors
from tesserine.operators.files import doc_chunks, rows_of


def hybrid_search(
    queries: DataFrame,
    corpus: DataFrame,
    index: bm25.Bm25Index | bm25.BatchIndex,
    payload: DataFrame,
    *,
    top_k: int = DEFAULTS.query_candidates,
    final_k: int = DEFAULTS.query_final,
    source_type: str | None = None,
    tags: list[str] | None = None,
    folder: str | None = None,
    strict_tags: bool = False,
    bm25_scope: str = "index",
    rerank: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """(query_id, id, rank, score, vector_score, relaxed) and the columns of ``payload`` (id, file_path, ...).

    ``queries`` has query_id, text and vector, ``corpus`` id and vector and
    what it is filtered by.  Filters work where the service has them:
    ``source_type`` before the vector search, ``folder`` after it, and on
    lexical hits among the best 3 * top_k.  ``bm25_scope="vector_hits"`` keeps
    its quirk that without a folder the lexical filters see only documents
    among the vector hits; ``tags`` apply to vector hits only where the query
    has no lexical hit, unless ``strict_tags``.
    """
    by_vector = vectors.search(corpus, queries, top_k, max(0.0, settings.score_threshold), source_type, folder)
    known = payload
    if bm25_scope == "vector_hits" and not folder:
        known = payload.join(by_vector.select("id").distinct(), "id", "left_semi")
    by_words = bm25.search(index, queries, top_k, known, source_type, tags, folder, settings)
    fused = fusion.rrf(by_vector, by_words, settings.rrf_k)
    if tags:
        tagged = payload.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))).select("id", F.lit(True).alias("__tagged"))
        lexical = by_words.select("query_id").distinct().withColumn("__lexical", F.lit(True))
        fused = fused.join(tagged, "id", "left").join(lexical, "query_id", "left")
        exempt = F.lit(False) if strict_tags else F.coalesce("__lexical", F.lit(False))
        fused = fused.where(exempt | F.coalesce("__tagged", F.lit(False))).drop("__tagged", "__lexical")
    fused = fused.where(F.col("rank") <= 2 * top_k)
    best = fusion.relevant(fused, final_k, settings.min_vector_score).persist()
    hits = best.join(rows_of(best, payload, "id"), "id", "left")
    if rerank:
        hits = fusion.reranked(hits, queries, settings.rerank_max, settings.rerank_gap)
    return hits.drop("vector_rank", "lexical_rank")


def retrieved(hits: DataFrame, snippet_lines: int = DEFAULTS.snippet_lines) -> DataFrame:
    """Hits with the fields of a result and their defaults; fields that the payload lacks are null."""
    have = set(hits.columns)
    field = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    return hits.select(
        "query_id", "rank", "id", "score", "vector_score",
        F.coalesce(field("file_path"), F.lit("")).alias("file_path"), F.coalesce(field("start_line", "int"), F.lit(0)).alias("start_line"), F.coalesce(field("end_line", "int"), F.lit(0)).alias("end_line"),
        field("division").alias("division"), field("section_name").alias("section_name"), field("paragraph_name").alias("paragraph_name"),
        text.truncate_lines(F.coalesce(field("code_snippet"), F.lit("")), snippet_lines).alias("code_snippet"),
        F.coalesce(field("language"), F.lit("COBOL")).alias("language"), F.coalesce(field("source_type"), F.lit("code")).alias("source_type"),
    )


def query(queries: DataFrame, corpus: DataFrame, index: bm25.Bm25Index | bm25.BatchIndex, payload: DataFrame, settings: Settings = DEFAULTS, **filters) -> DataFrame:
    """The search entry point: hybrid search, per-file diversity, result fields."""
    hits = hybrid_search(queries, corpus, index, payload, top_k=settings.query_candidates, final_k=settings.query_candidates, settings=settings, **filters)
    return retrieved(fusion.diverse(hits, settings.max_per_file, settings.query_final), settings.snippet_lines)


def prefetch(queries: DataFrame, corpus: DataFrame, index: bm25.Bm25Index | bm25.BatchIndex, payload: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """What is cached ahead of a question: long enough questions, reranked, without the per-file cap."""
    asked = queries.where(F.length(F.trim("text")) >= settings.prefetch_min_length)
    hits = hybrid_search(asked, corpus, index, payload, top_k=settings.prefetch_candidates, final_k=settings.prefetch_final, rerank=True, settings=settings)
    return retrieved(hits, settings.snippet_lines)


def ask(queries: DataFrame, corpus: DataFrame, index: bm25.Bm25Index | bm25.BatchIndex, payload: DataFrame, cached: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks for an answer: cached ones where there are, else a live search with the per-file cap."""
    live = queries if cached is None else queries.join(cached.select("query_id").distinct(), "query_id", "left_anti")
    hits = hybrid_search(live, corpus, index, payload, top_k=settings.prefetch_candidates, final_k=settings.prefetch_final, settings=settings)
    found = retrieved(fusion.diverse(hits, settings.max_per_file, settings.prefetch_final), settings.snippet_lines)
    return found if cached is None else found.unionByName(cached)


def chat(queries: DataFrame, corpus: DataFrame, index: bm25.Bm25Index | bm25.BatchIndex, payload: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks for a chat: of the documentation file that a question names, if it has chunks, else by search."""
    named = queries.select("query_id", paths.doc_file(F.col("text")).alias("name"))
    placed = payload.withColumn("chunk_id", F.col("id"))
    if "start_line" not in placed.columns:
        placed = placed.withColumn("start_line", F.lit(0))
    routed = doc_chunks(placed, named, settings.chat_final).drop("chunk_id").withColumns({"score": F.lit(0.0), "vector_score": F.lit(None).cast("double")})
    rest = queries.join(routed.select("query_id").distinct(), "query_id", "left_anti").persist()
    hits = hybrid_search(rest, corpus, index, payload, top_k=settings.chat_candidates, final_k=settings.chat_final, settings=settings)
    found = retrieved(fusion.diverse(hits, settings.max_per_file, settings.chat_final), settings.snippet_lines)
    return retrieved(routed, settings.snippet_lines).unionByName(found)
