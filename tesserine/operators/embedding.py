"""Embeddings with a content-addressed cache and a pluggable provider."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.config import DEFAULTS
from tesserine.functions.ids import pseudo_embedding

Provider = Callable[[DataFrame], DataFrame]


class EmbeddingCache:
    """Vectors (or what else a provider gives, in ``column``) by the digest of their text, as a Parquet table that is only appended to."""

    def __init__(self, spark: SparkSession, path: str, column: str = "vector"):
        self.spark, self.path, self.column = spark, path.rstrip("/"), column

    def _exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def read(self) -> DataFrame | None:
        """(sha, ``column``), each digest once; None if there is no cache yet."""
        return self.spark.read.parquet(self.path).dropDuplicates(["sha"]) if self._exists() else None

    def append(self, added: DataFrame) -> None:
        added.select("sha", self.column).write.mode("append").parquet(self.path)

    def drop(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def pseudo_provider(dim: int = DEFAULTS.embedding_dim) -> Provider:
    """The default provider: deterministic values from the text's digest. A provider maps (sha, text) to (sha, vector)."""
    return lambda rows: rows.select("sha", pseudo_embedding(F.col("text"), dim).alias("vector"))


def probe(rows: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``sha`` and the cached ``vector``, null where there is none."""
    return rows.withColumn("sha", text_key(F.col(text))).join(cache.dropDuplicates(["sha"]).select("sha", "vector"), "sha", "left")


def embed(rows: DataFrame, cache: DataFrame | None = None, provider: Provider | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``vector``, what the provider added to the cache); each distinct text is asked for once."""
    provider = provider or pseudo_provider()
    keyed = rows.withColumn("sha", text_key(F.col(text)))
    asked = keyed.select("sha", F.col(text).alias("text")).dropDuplicates(["sha"])
    if cache is not None:
        asked = asked.join(cache, "sha", "left_anti")
    added = provider(asked).select("sha", "vector")
    known = added if cache is None else cache.select("sha", "vector").dropDuplicates(["sha"]).unionByName(added)
    return keyed.join(known, "sha", "left").drop("sha"), added


def answered(rows: DataFrame, cache: EmbeddingCache, provider: Provider, text: str, otherwise: Column | None = None) -> DataFrame:
    """``rows`` with the cache's column.

    Each distinct text that is not in the cache is asked for once, and what the
    provider gives is written before it is used, so whatever reads the result asks
    for nothing again.  Texts without an answer get ``otherwise`` and stay out of
    the cache, so the next run asks for them.
    """
    column = cache.column
    keyed = rows.withColumn("sha", text_key(F.col(text)))
    asked, known = keyed.select("sha", F.col(text).alias("text")).dropDuplicates(["sha"]), cache.read()
    cache.append(provider(asked if known is None else asked.join(known, "sha", "left_anti")).where(F.col(column).isNotNull()))
    full = keyed.join(cache.read(), "sha", "left").drop("sha")
    return full if otherwise is None else full.withColumn(column, F.coalesce(column, otherwise))
