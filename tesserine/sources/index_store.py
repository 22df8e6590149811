"""BM25 indexes on disk, kept up in steps of the size of what changed.

An index is a row of versions.  ``b<n>`` is a whole index; ``d<n>`` is one upsert or
delete after it: the postings of its documents, the ids it makes void in all
versions before (``gone``, tombstones and replaced documents), and by how much it
changes document frequencies, the number of documents and their length.  A read
takes postings whose document no later version made void and adds the differences
up.  After ``MAX_DELTAS`` versions they are merged.  A version counts once its
last table is there, so readers never see half of one, and doing an upsert again
changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators import bm25

_loaded: dict[str, tuple[str, bm25.Bm25Index]] = {}


class IndexStore:
    MAX_DELTAS = 8

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return base, base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _all(self) -> list[tuple[int, str]]:
        base, fs = self._files()
        if not fs.exists(base):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(base) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "stats/_SUCCESS"))]
        return sorted((int(n[1:]), n) for n in names if n[:1] in "bd" and n[1:].isdigit())

    def versions(self) -> list[str]:
        """The last whole version and what came after it."""
        found = self._all()
        first = max((k for k, (_, n) in enumerate(found) if n[0] == "b"), default=0)
        return [n for _, n in found[first:]]

    def _table(self, version: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{version}/{name}")

    def _union(self, names: list[str], table: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._table(n, table) for n in names])

    def _postings(self, names: list[str]) -> DataFrame:
        """Postings of documents that no later version made void."""
        live = self._table(names[-1], "postings")
        for k in range(len(names) - 2, -1, -1):
            gone = self._union(names[k + 1 :], "gone").distinct()
            live = self._table(names[k], "postings").join(gone, "id", "left_anti").unionByName(live)
        return live

    def read(self) -> bm25.Bm25Index:
        names = self.versions()
        terms = self._union(names, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        corpus = self._union(names, "stats").agg(F.sum("n").alias("n"), F.try_divide(F.sum("length"), F.sum("n")).alias("avgdl"))
        return bm25.Bm25Index(self._postings(names), terms, bm25.corpus_stats(corpus, terms))

    def current(self) -> bm25.Bm25Index:
        """The index, kept in memory until it changes."""
        stamp = ",".join(self.versions())
        known = _loaded.get(self.path)
        if known is None or known[0] != stamp:
            if known is not None:
                known[1].unpersist()
            _loaded[self.path] = known = (stamp, self.read().persist())
        return known[1]

    def _write(self, name: str, postings: DataFrame, gone: DataFrame, terms: DataFrame, stats: DataFrame) -> None:
        """``stats`` come last. Postings are clustered by term, so that a query's terms prune row groups."""
        for table, rows in (("postings", postings.repartitionByRange("term").sortWithinPartitions("term")), ("gone", gone), ("terms", terms), ("stats", stats)):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/{table}")

    def _next(self, kind: str) -> str:
        found = self._all()
        return f"{kind}{(found[-1][0] if found else 0) + 1}"

    def write(self, index: bm25.Bm25Index) -> None:
        """A whole index as the next version."""
        stats = index.stats.select("n", F.round(F.coalesce(F.col("n") * F.col("avgdl"), F.lit(0.0))).cast("long").alias("length"))
        self._write(self._next("b"), index.postings, index.postings.select("id").limit(0), index.terms, stats)

    def upsert(self, docs: DataFrame, doc_id: str, body: str) -> None:
        """Insert or replace documents. One without a token leaves the index if it was there."""
        names, words = self.versions(), bm25.tokenised(docs, doc_id, body).dropDuplicates(["id"]).persist()
        self._step(names, bm25.counted(words), words.select("id"))
        words.unpersist()

    def delete(self, ids: DataFrame) -> None:
        """Leave out the documents of ``ids`` (id)."""
        names = self.versions()
        if names:
            self._step(names, self._table(names[-1], "postings").limit(0), ids.select("id").distinct())

    def _step(self, names: list[str], postings: DataFrame, gone: DataFrame) -> None:
        postings = postings.persist()
        one = lambda rows, sign: rows.groupBy("id").agg(F.first("dl").alias("dl")).select(F.lit(sign).alias("n"), (sign * F.col("dl")).alias("length"))
        terms, sizes = postings.select("term", F.lit(1).alias("df")), one(postings, 1)
        if names:
            void = self._postings(names).join(gone, "id", "left_semi").persist()
            terms, sizes = terms.unionByName(void.select("term", F.lit(-1).alias("df"))), sizes.unionByName(one(void, -1))
        terms = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        stats = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
        self._write(self._next("d" if names else "b"), postings, gone, terms, stats)
        postings.unpersist()
        if names:
            void.unpersist()
        if len(names) >= self.MAX_DELTAS:
            self.compact()

    def compact(self) -> None:
        """Merge all versions into one; what is before the last whole one, which a reader may still use, stays until the next time."""
        found, used = self._all(), self.versions()
        self.write(self.read())
        base, fs = self._files()
        for _, name in found:
            if name not in used:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(base, name), True)

    def reset(self) -> None:
        """Delete the index and forget what is loaded of it."""
        base, fs = self._files()
        fs.delete(base, True)
        if (known := _loaded.pop(self.path, None)) is not None:
            known[1].unpersist()
