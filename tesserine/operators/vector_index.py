"""Vector search in cells, and a coarse quantiser for approximate search.

Questions and rows are both DataFrames.  Each list of rows is cut into parts of at
most about ``ROWS``, its questions into parts of about ``QUESTIONS``; a cell holds
one of each, multiplies them and gives its best rows a question.  A list or a set
of questions of any size is thus many cells, and neither comes to the driver.

``VectorIndex`` puts every row into the list of its nearest centroid.  Centroids
are learned from a bounded sample; a search looks through the lists whose
centroids are nearest to the question, with the exact scores of the rows there.
With all lists it is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators.bm25 import DIGITS, ranked

ROWS, QUESTIONS = 32_768, 2_048
#: Rows that centroids are learned from, the most centroids, and rounds of learning.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4_096, 12
PROBES = 16


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of unit length (zero vectors stay)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def best_rows(values: np.ndarray, key: np.ndarray, limit: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a matrix of scores (questions, rows): places of the best ``limit`` a question, ties to the lesser key, and their scores."""
    questions, rows = [], []
    for q, line in enumerate(values):
        keep = np.arange(len(line)) if least is None else np.flatnonzero(line >= least)
        if len(keep) > limit:
            edge = np.partition(line[keep], len(keep) - limit)[len(keep) - limit]
            keep = keep[line[keep] >= edge]
            keep = keep[np.lexsort((key[keep], -line[keep]))][:limit]
        questions.append(np.full(len(keep), q))
        rows.append(keep)
    q, r = np.concatenate([np.empty(0, np.int64), *questions]), np.concatenate([np.empty(0, np.int64), *rows])
    return q, r, values[q, r]


def meet(rows: DataFrame, questions: DataFrame, limit: int, least: float | None) -> DataFrame:
    """(query_id, id, score) of the best rows of each cell; ``rows`` (list, id, vector), ``questions`` (list, query_id, vector)."""
    n = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("parts"))
    m = questions.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUESTIONS).cast("int").alias("blocks"))
    # A row a list, of which there are at most MOST_LISTS.
    sizes = F.broadcast(n.join(m, "list"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("block", upto("blocks"))
    right = questions.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("part", upto("parts"))
    cell, kind = ["list", "part", "block"], rows.schema["id"].dataType.simpleString()

    def score(mine: pa.Table, asked: pa.Table) -> pa.Table:
        ids, names = mine.column("id").combine_chunks(), asked.column("query_id").combine_chunks()
        if not len(ids) or not len(names):
            return pa.table([ids.slice(0, 0), names.slice(0, 0), pa.array([], pa.float64())], ["id", "query_id", "score"])
        vectors, key = matrix(mine.column("l_vector")), ids.to_numpy(zero_copy_only=False)
        found = []
        for k in range(0, len(names), 256):
            some = np.round(matrix(asked.column("r_vector").slice(k, 256)) @ vectors.T, DIGITS)
            q, r, s = best_rows(some, key, limit, least)
            found.append((q + k, r, s))
        q, r, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([ids.take(pa.array(r)), names.take(pa.array(q)), pa.array(s)], ["id", "query_id", "score"])

    # Rows and questions may come from one frame: new names tell their columns apart.
    mine = left.select(*(F.col(c).alias(f"l_{c}") for c in cell), "id", F.col("vector").alias("l_vector"))
    asked = right.select(*(F.col(c).alias(f"r_{c}") for c in cell), "query_id", F.col("vector").alias("r_vector"))
    met = mine.groupBy(*(f"l_{c}" for c in cell)).cogroup(asked.groupBy(*(f"r_{c}" for c in cell)))
    return met.applyInArrow(score, f"id {kind}, query_id {questions.schema['query_id'].dataType.simpleString()}, score double").select("query_id", "id", "score")


def exact(corpus: DataFrame, queries: DataFrame, limit: int, least: float | None = 0.0) -> DataFrame:
    """(query_id, id, score, rank) of any number of questions (query_id, vector) against all rows (id, vector)."""
    one = lambda frame, name: frame.where(F.col("vector").isNotNull()).select(F.size("vector").alias("list"), name, "vector")
    return ranked(meet(one(corpus, "id"), one(queries, "query_id"), limit, least), limit)


def centroids_of(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by cosine; one that loses all its rows takes the row that is worst off."""
    found = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(np.int64)].copy()
    for _ in range(rounds):
        near = sample @ found.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(found)) == 0)
        sums[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms == 0, found, sums / np.where(norms == 0, 1, norms))
    return found


@dataclass
class VectorIndex:
    """``rows`` (list, id, vector) of all vectors, and the lists' centroids."""

    rows: DataFrame
    centroids: np.ndarray

    @classmethod
    def build(cls, corpus: DataFrame, lists: int | None = None) -> VectorIndex:
        """Index of ``corpus`` (id, vector); vectors of another length than most of the sample, and null ones, are left out."""
        whole = corpus.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).select("id", "vector")
        sample = whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("vector").combine_chunks()
        sizes = np.asarray(sample.value_lengths())
        if not len(sizes):
            return cls(whole.select(F.lit(0).alias("list"), "id", "vector"), np.zeros((0, 0)))
        size = int(np.bincount(sizes).argmax())
        n = min(MOST_LISTS, lists or max(1, round(whole.count() ** 0.5)))
        found = centroids_of(matrix(sample.filter(pa.array(sizes == size))), n)
        fitting = whole.where(F.size("vector") == size)
        return cls(_near(fitting, found, 1, "id"), found)

    def save(self, path: str) -> None:
        """Rows lie by list, so that a search reads the lists it wants."""
        self.rows.repartitionByRange("list").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame(list(enumerate(self.centroids.tolist())), "list int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        found = spark.read.parquet(f"{path}/centroids").orderBy("list").limit(MOST_LISTS).collect()
        return cls(spark.read.parquet(f"{path}/rows"), np.array([r["vector"] for r in found], np.float64).reshape(len(found), -1))

    def search(self, queries: DataFrame, limit: int, probes: int = PROBES, least: float | None = 0.0) -> DataFrame:
        """(query_id, id, score, rank) among the rows of the ``probes`` lists that are nearest to each question (query_id, vector)."""
        asked = queries.where(F.size("vector") == self.centroids.shape[1]).select("query_id", "vector")
        return ranked(meet(self.rows, _near(asked, self.centroids, min(probes, max(1, len(self.centroids))), "query_id"), limit, least), limit)


def _near(vectors: DataFrame, centroids: np.ndarray, n: int, name: str) -> DataFrame:
    """(list, ``name``, vector) with the ``n`` nearest lists of each vector; the centroids go with the plan (at most MOST_LISTS)."""
    kind = vectors.schema[name].dataType.simpleString()
    element = vectors.schema["vector"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = matrix(batch.column("vector")) @ centroids.T
            lists = np.argsort(-near, axis=1, kind="stable")[:, :n] if n > 1 else near.argmax(axis=1)[:, None]
            at = pa.array(np.repeat(np.arange(len(batch)), lists.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), batch.column(name).take(at), batch.column("vector").take(at)], ["list", name, "vector"])

    return vectors.mapInArrow(assign, f"list int, {name} {kind}, vector {element}")
