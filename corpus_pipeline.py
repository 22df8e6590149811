"""Corpus preparation from documents to packed token sequences, as a list of stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.

Defined results: a null or empty text fails the quality rules; repeated rows are
exact copies; an empty table gives no pieces; further columns of ``documents``,
whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.bag_minhash import drop_near_duplicates
from tesserine.llm.common import Scratch, fresh
from tesserine.llm.exact_dedup import drop_copies
from tesserine.llm.packing import pack_documents
from tesserine.llm.quality_rules import quality_rules
from tesserine.llm.queries import tokenizer_path
from tesserine.llm.repeated_spans import remove_repeated_spans

#: Repeated passages that go: of fifty words or more, covered by byte strings of this size that start anywhere else.
#: Fifty words of fewer bytes than that would be under four letters each.
PASSAGE_BYTES = 200
PASSAGE_WORDS = 50

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    # As a struct the columns of a row keep their names and values, whatever the rules call their results.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), "text")
    return quality_rules(rows).where("kept").select("whole.*")


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies."""
    return drop_copies(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return drop_near_duplicates(docs)


def without_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur twice or more; n_chars follows the text."""
    own = fresh(docs, "own_n_removed")
    cut = remove_repeated_spans(docs.withColumnRenamed("n_removed", own), threshold=PASSAGE_BYTES, least_words=PASSAGE_WORDS)
    cut = cut.drop("n_removed").withColumnRenamed(own, "n_removed")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences."""
    return pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("exact_dedup", one_of_copies),
    ("near_dedup", one_of_near_copies),
    ("suffix_dedup", without_repeated_spans),
    ("best_fit_packing", packed),
]

#: Token ids are not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; only the last one's files stay."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        scratch.remove(before)
    return docs
