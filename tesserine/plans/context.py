"""Prompt contexts and event rows from retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The frame of contexts and prompts.
SEPARATOR = "\n\n---\n\n"
PROMPT_HEAD = "\n---\n\n**Context** (numbered chunks; each has file path, line range, then code):\n\n"
PROMPT_QUESTION, PROMPT_END = "\n\n---\n\n**Question:** ", "\n\n**Answer:**"
NO_CHUNKS = "(No chunks retrieved.)"


def plain_entry() -> Column:
    """``[i] path Lx-y`` and the snippet."""
    return F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("file_path"), F.lit(" L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"), F.coalesce("code_snippet", F.lit("")))


def chat_entry() -> Column:
    """The same with paragraph, section (if another) and relevance in the first line."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("file_path"), F.lit(" L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    parts = F.concat_ws(
        " | ",
        head,
        F.when(F.length("paragraph_name") > 0, F.concat(F.lit("para:"), F.col("paragraph_name"))),
        F.when((F.length("section_name") > 0) & ~F.col("section_name").eqNullSafe(F.col("paragraph_name")), F.concat(F.lit("section:"), F.col("section_name"))),
        F.when(F.col("vector_score").isNotNull(), F.concat(F.lit("relevance:"), F.format_string("%.2f", F.col("vector_score")))),
    )
    return F.concat(parts, F.lit("\n"), F.coalesce("code_snippet", F.lit("")))


def contexts(chunks: DataFrame, entry: Column) -> DataFrame:
    """(query_id, context, n_chunks): the entries of a query's chunks in order of rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return chunks.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["entry"]), SEPARATOR).alias("context"), F.count(F.lit(1)).alias("n_chunks"))


def chat_prompts(queries: DataFrame, chunks: DataFrame, system: str) -> DataFrame:
    """(query_id, prompt) for an answer provider; questions without chunks say so."""
    joined = queries.join(contexts(chunks, chat_entry()), "query_id", "left")
    body = F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit(NO_CHUNKS))
    return joined.select("query_id", F.concat(F.lit(system), F.lit(PROMPT_HEAD), body, F.lit(PROMPT_QUESTION), F.col("text"), F.lit(PROMPT_END)).alias("prompt"))


def event_rows(answers: DataFrame) -> DataFrame:
    """(query_id, seq, event, data) of streamed answers (query_id, intro_parts, result).

    Parts of the intro, its end, the result and ``done``; without a result an
    empty intro, the empty result and ``done``.
    """
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    parts = F.transform("intro_parts", lambda p: event("intro_chunk", F.to_json(F.struct(p.alias("text")))))
    done = event("done", F.lit('{"ok":true}'))
    full = F.concat(parts, F.array(event("intro_done", F.to_json(F.struct(F.array_join("intro_parts", "").alias("text")))), event("result", F.to_json("result")), done))
    empty = F.array(event("intro", F.lit('{"text":""}')), event("result", F.lit("{}")), done)
    rows = F.when(F.col("result").isNull(), empty).otherwise(full)
    return answers.select("query_id", F.posexplode(rows).alias("seq", "e")).select("query_id", "seq", "e.event", "e.data")


def parsed_events(stream: Column) -> Column:
    """Array of (event, data) of a server-sent event text; blocks end with an empty line, the last may lack it."""
    blocks = F.filter(F.split(stream, "\n\n"), lambda b: F.trim(b) != "")
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"(?m)^event: ?(.*)$", 1).alias("event"), F.regexp_extract(b, r"(?m)^data: ?(.*)$", 1).alias("data")))
