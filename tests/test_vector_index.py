"""Vector search in cells, and how much of it the coarse quantiser finds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.operators import vector_index, vectors


def clusters(spark, n, seed, dim=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(25, dim))
    rows = middle[rng.integers(0, 25, n)] + 0.35 * rng.normal(size=(n, dim))
    # A third of all rows are alike: one list, several parts.
    rows[: n // 3] = middle[0] + 0.01 * rng.normal(size=(n // 3, dim))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, vector array<double>").repartition(4)


def found(frame):
    return sorted(tuple(r) for r in frame.select("query_id", "rank", "id", "score").collect())


def test_cells_equal_one_matrix(spark, monkeypatch):
    corpus = clusters(spark, 900, 1).unionByName(spark.createDataFrame([(2000, None), (2001, [1.0]), (2002, [0.0] * 12)], "id long, vector array<double>"))
    queries = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    expected = found(vectors.search(corpus, queries, 7))
    monkeypatch.setattr(vector_index, "ROWS", 100)
    monkeypatch.setattr(vector_index, "QUESTIONS", 9)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 10)
    assert found(vectors.search(corpus, queries, 7)) == expected
    assert found(vector_index.exact(corpus, queries.limit(0), 7)) == []


def test_recall_of_the_quantiser(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "ROWS", 300)
    corpus = clusters(spark, 3000, 2)
    queries = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = {(q, i) for q, _, i, _ in found(vector_index.exact(corpus, queries, 10, None))}
    index = vector_index.VectorIndex.build(corpus)
    assert index.rows.count() == 3000 and len(index.centroids) == 55
    few = {(q, i) for q, _, i, _ in found(index.search(queries, 10, 12, None))}
    assert len(few & exact) / len(exact) >= 0.95
    index.save(str(tmp_path))
    again = vector_index.VectorIndex.load(spark, str(tmp_path))
    assert {(q, i) for q, _, i, _ in found(again.search(queries, 10, 12, None))} == few
    assert {(q, i) for q, _, i, _ in found(again.search(queries, 10, 55, None))} == exact


def test_index_of_odd_tables(spark):
    none = spark.createDataFrame([(1, None)], "id long, vector array<double>")
    assert vector_index.VectorIndex.build(none).search(none.select(F.col("id").alias("query_id"), "vector"), 3).count() == 0
    one = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0])], "id long, vector array<double>")
    index = vector_index.VectorIndex.build(one, 5)
    got = found(index.search(one.select(F.col("id").alias("query_id"), "vector"), 3, 5))
    assert got == [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (2, 1, 2, 1.0), (2, 2, 1, 0.0)]


@pytest.mark.parametrize("probes", [4])
def test_recall_on_the_test_tables(spark, probes):
    import os

    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    corpus = spark.read.parquet(path).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = {(q, i) for q, _, i, _ in found(vector_index.exact(corpus, queries, 10))}
    few = {(q, i) for q, _, i, _ in found(vector_index.VectorIndex.build(corpus).search(queries, 10, probes * 4))}
    print("recall", len(few & exact) / len(exact))
    assert len(few & exact) / len(exact) >= 0.95
