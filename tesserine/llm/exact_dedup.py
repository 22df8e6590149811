"""Exact deduplication by a tree-merge of sorted digest runs.

Each input partition forms a run of digests with one retained row a digest.
Runs are then merged ``FAN_IN`` at a time, in ceil(log_FAN_IN(runs)) rounds, as
in a binomial tree with a wider fan.  A round is keyed by (merged run, digest),
so the sort-based shuffle is the multiway merge and, as in a recursive-halving
exchange, no task receives a whole run: each holds a hash slice of the digests
of the runs it merges.  Copies meet as early as they can: a group of any size
sends at most one row a run into each round.

What is retained at every level is verified: rows fall into one group only if
SHA-256, normalised length and a second 64-bit hash agree.

Defined results: null counts as the empty text; all texts without a visible
character are equal.  The row that stays has the most code points in the
original text, then the smallest doc_id (null last); of rows that repeat an
identifier with texts of the same length one stays.  Further columns of the
input are not read by ``exact_dedup``; ``drop_copies`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import SPACE, checkpoint, keep_rows, text_key

FAN_IN = 8
KEY = ["__digest", "__length", "__check"]


def _best() -> Column:
    """Most code points, then smallest id (null last), then one of the rows that are left."""
    return F.min(F.col("__best"))


def digest_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A slim row for each document, with the run it belongs to."""
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.length(whole).alias("__chars"), F.regexp_replace(whole, f"{SPACE}+", "").alias("__normal"))
    return slim.select(
        "doc_id",
        "text_key",
        "__chars",
        F.unhex(F.sha2("__normal", 256)).alias("__digest"),
        F.octet_length("__normal").alias("__length"),
        F.xxhash64("__normal").alias("__check"),
        F.monotonically_increasing_id().alias("__row"),
        F.spark_partition_id().alias("__run"),
    )


def merge_runs(rows: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """One retained row and a count for each digest of all runs."""
    best = F.struct((-F.col("__chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("__row").alias("r"))
    merged = rows.select(*KEY, "__run", best.alias("__best"), F.lit(1).cast("long").alias("__n"))
    for _ in range(max(1, math.ceil(math.log(max(n_runs, 2), fan_in)))):
        merged = (
            merged.withColumn("__run", F.floor(F.col("__run") / fan_in)).groupBy(*KEY, "__run").agg(_best().alias("__best"), F.sum("__n").alias("__n"))
        )
    return merged.drop("__run")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and text_key (of the original text) of every row."""
    rows = checkpoint(digest_rows(docs, doc_id, text))
    retained = merge_runs(rows, rows.rdd.getNumPartitions())
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in KEY]
    return (
        rows.alias("a")
        .join(retained.alias("b"), same)
        .select(
            "a.doc_id",
            F.col("b.__best.id").alias("keep_id"),
            F.col("b.__n").alias("group_size"),
            (F.col("a.__row") == F.col("b.__best.r")).alias("kept"),
            F.lower(F.hex("a.__digest")).alias("text_sha256"),
            "a.text_key",
        )
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    return keep_rows(docs, checkpoint(exact_dedup(docs, doc_id, text).select("doc_id", "text_key", "kept")), doc_id, text)
