"""Exact vector search of a batch of queries against all rows.

Up to ``BLOCK_QUERIES`` query vectors are a matrix of bounded size that goes to
the tasks with the plan; each Arrow batch of the corpus is multiplied with it and
keeps its best rows a query, so what is shuffled is ``limit`` rows a query and
batch whatever the corpus holds, and there is no join.  More queries stay a
DataFrame and meet the corpus in cells (``vector_index``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.operators.bm25 import DIGITS, ranked
from tesserine.operators.vector_index import best_rows, exact

BLOCK_QUERIES = 2048


def _best_of(matrix: np.ndarray, names: np.ndarray, limit: int, least: float | None, corpus: DataFrame) -> DataFrame:
    schema = f"query_id long, id {corpus.schema['id'].dataType.simpleString()}, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column("id"), batch.column("vector")
            vectors = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            norms = np.linalg.norm(vectors, axis=1)
            values = np.round(matrix @ vectors.T / np.where(norms == 0, 1, norms), DIGITS)
            queries, rows, found = best_rows(values, ids.to_numpy(zero_copy_only=False), limit, least)
            yield pa.RecordBatch.from_arrays([pa.array(names[queries]), ids.take(pa.array(rows)), pa.array(found)], ["query_id", "id", "score"])

    return corpus.select("id", "vector").mapInArrow(scan, schema)


def search(corpus: DataFrame, queries: DataFrame, limit: int, least: float | None = 0.0, source_type: str | None = None, folder: str | None = None) -> DataFrame:
    """(query_id, id, score, rank) by cosine.

    ``corpus`` has id and vector; ``source_type`` filters it before the search,
    ``folder`` filters the result (its column ``folder``), as in the service.
    Rows whose vector is null or of another size are left out.
    """
    if source_type and source_type != "all":
        corpus = corpus.where(F.col("source_type") == source_type)
    mine = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    rows = mine.limit(BLOCK_QUERIES + 1).collect()
    if len(rows) > BLOCK_QUERIES:
        best = exact(corpus, mine, limit, least)
    elif not rows:
        return ranked(corpus.select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0), limit)
    else:
        matrix = np.array([r["vector"] for r in rows], np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        sized = corpus.where(F.size("vector") == matrix.shape[1])
        best = ranked(_best_of(matrix / np.where(norms == 0, 1, norms), np.array([r["query_id"] for r in rows]), limit, least, sized), limit)
    if folder:
        best = best.join(corpus.where(F.col("folder") == folder).select("id"), "id", "left_semi")
        best = ranked(best.drop("rank"), limit)
    return best
