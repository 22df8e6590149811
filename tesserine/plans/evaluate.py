"""Evaluation runs: from the rows of an evaluation set to one report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.operators import evals

#: From (query_id, text, source_type, tags) to (query_id, path, rank, and maybe ms, the time of the query).
Run = Callable[[DataFrame], DataFrame]


def numbered(rows: DataFrame) -> DataFrame:
    """Evaluation rows with a question, with query_id (a name by content; rows that repeat a question with the same filters are one)."""
    asked = rows.withColumn("text", F.trim("query")).where("text <> ''")
    kind = F.coalesce("source_type", F.lit("all"))
    return asked.withColumn("source_type", kind).withColumn("query_id", F.xxhash64("text", "source_type", F.coalesce(F.array_join("tags", "\n"), F.lit("")))).dropDuplicates(["query_id"])


def retrieval_report(rows: DataFrame, run: Run, k: int = 10) -> DataFrame:
    """One row: queries_total, queries_scored, hit_rate_at_k, recall_at_k and mrr, and latency statistics if the run has ``ms``.

    A question without expected paths counts as missed.
    """
    asked = numbered(rows)
    hits = run(asked.select("query_id", "text", "source_type", "tags"))
    wanted = asked.select("query_id", F.explode_outer("expected_paths").alias("path"))
    report = evals.averaged(evals.query_metrics(hits.select("query_id", "path", "rank"), wanted, k))
    report = asked.agg(F.count(F.lit(1)).alias("queries_total")).crossJoin(report)  # a row each
    if "ms" in hits.columns:
        times = hits.groupBy("query_id").agg(F.max("ms").alias("ms")).withColumn("all", F.lit(1))
        summary = evals.latency_summary(times, "all", "ms")
        report = report.crossJoin(summary.select(F.col("mean").alias("latency_ms_avg"), F.col("p95").alias("latency_ms_p95"), F.col("p99").alias("latency_ms_p99"), F.col("stdev").alias("latency_ms_stdev")))
    return report


def answer_report(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: queries_scored and pass_rate of ``answers`` (query_id, answer) to the questions that name phrases; a missing answer is an empty one."""
    some = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.trim(s) != "")
    asked = numbered(rows).where(some(F.col("answer_must_contain")) | some(F.col("answer_must_not_contain")))
    met = asked.join(answers, "query_id", "left").withColumn("all", F.lit(1))
    return evals.pass_rate(met, "all", evals.answer_ok(F.col("answer"), F.col("answer_must_contain"), F.col("answer_must_not_contain"))).drop("all")
