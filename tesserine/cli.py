"""Command line: ingest a folder, ask questions, run an evaluation set, look at a store.

    python -m tesserine.cli ingest SOURCES --store STORE [--extensions c,h,cbl] [--max-files N] [--reset]
    python -m tesserine.cli query --store STORE "first question" "second question" [--top-k N] [--folder F] [--tag T]
    python -m tesserine.cli evaluate SET.jsonl --store STORE [--top-k N] [--answers ANSWERS.jsonl]
    python -m tesserine.cli status --store STORE

Each prints JSON.  Questions of one call are one plan.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.config import Settings
from tesserine.functions.ids import pseudo_embedding
from tesserine.plans import evaluate, ingest, search
from tesserine.session import session
from tesserine.sources import discovery
from tesserine.sources.index_store import IndexStore
from tesserine.sources.store import ChunkStore


def answers_to(spark: SparkSession, store_path: str, asked: DataFrame, settings: Settings, **filters) -> DataFrame:
    """Results of ``asked`` (query_id, text) from the store and the index under ``store_path``."""
    chunks = ChunkStore(spark, f"{store_path}/chunks").read().withColumnRenamed("chunk_id", "id")
    questions = asked.withColumn("vector", pseudo_embedding(F.col("text"), settings.embedding_dim))
    return search.query(questions, chunks, IndexStore(spark, f"{store_path}/index").current(), chunks.drop("vector"), settings, **filters)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tesserine", description="Index, search and evaluate source collections.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "query", "evaluate", "status"):
        command = commands.add_parser(name)
        command.add_argument("--store", required=True)
        command.add_argument("--master")
        if name == "ingest":
            command.add_argument("root")
            command.add_argument("--extensions", default="*")
            command.add_argument("--max-files", type=int)
            command.add_argument("--reset", action="store_true")
        if name == "query":
            command.add_argument("question", nargs="+")
            command.add_argument("--folder")
            command.add_argument("--tag", action="append")
            command.add_argument("--source-type")
        if name == "evaluate":
            command.add_argument("dataset")
            command.add_argument("--answers", help="JSON lines of query and answer, to be checked for phrases")
        if name in ("query", "evaluate"):
            command.add_argument("--top-k", type=int, default=15 if name == "query" else 10)
            command.add_argument("--score-threshold", type=float, default=0.0)
    options = parser.parse_args(arguments)
    spark = SparkSession.getActiveSession() or session("tesserine", options.master)
    shown = {"ingest": _ingest, "query": _query, "evaluate": _evaluate, "status": _status}[options.command](spark, options)
    if shown is None:
        return 1
    print(json.dumps(shown, indent=2, default=str))
    return 0


def _settings(spark: SparkSession, options: argparse.Namespace) -> Settings:
    return replace(Settings.of(spark), query_final=options.top_k, score_threshold=options.score_threshold)


def _ingest(spark: SparkSession, options: argparse.Namespace) -> dict:
    files, chunks = ingest.ingest(spark, options.root, options.store, options.extensions, options.max_files, options.reset)
    return {"files": files, "chunks": chunks}


def _query(spark: SparkSession, options: argparse.Namespace) -> list[dict]:
    asked = spark.createDataFrame(list(enumerate(options.question)), "query_id long, text string")
    found = answers_to(spark, options.store, asked, _settings(spark, options), source_type=options.source_type, tags=options.tag, folder=options.folder)
    # At most top_k rows a question of the command line.
    rows = [r.asDict() for r in found.where(F.col("rank") <= options.top_k).orderBy("query_id", "rank").collect()]
    return [{"query": q, "results": [{k: v for k, v in r.items() if k != "query_id"} for r in rows if r["query_id"] == i]} for i, q in enumerate(options.question)]


def _evaluate(spark: SparkSession, options: argparse.Namespace) -> dict | None:
    rows = discovery.eval_rows(spark, options.dataset)
    if not rows.take(1):
        print("the evaluation set has no rows", file=sys.stderr)
        return None
    run = lambda asked: answers_to(spark, options.store, asked, _settings(spark, options)).select("query_id", F.col("file_path").alias("path"), "rank")
    report = {"retrieval": evaluate.retrieval_report(rows, run, options.top_k).first().asDict()}
    if options.answers:
        given = spark.read.schema("query string, answer string").json(options.answers)
        answers = evaluate.numbered(rows).join(given.dropDuplicates(["query"]), "query").select("query_id", "answer")
        report["answers"] = evaluate.answer_report(rows, answers).first().asDict()
    return report


def _status(spark: SparkSession, options: argparse.Namespace) -> dict:
    return ingest.status(spark, options.store)


if __name__ == "__main__":
    sys.exit(main())
