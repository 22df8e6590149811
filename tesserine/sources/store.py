"""The chunk store: Parquet tables with idempotent upserts.

An upsert writes its rows as a new version next to the ones before, and a read
takes of each key the row of the newest version that has it.  After
``MAX_DELTAS`` versions they are merged into one.  So a micro-batch costs its
own size and not the store's, readers never see half of a version (one without
``_SUCCESS`` does not count), and a lost executor costs a task, not data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def last_write_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key, the last by ``order``; aggregated on the map side, so a key of many rows is no hot task."""
    rest = [c for c in rows.columns if c != key]
    stamp = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("row"))
    return rows.groupBy(key).agg(F.max(stamp)["row"].alias("row")).select(key, "row.*").select(rows.columns)


class ChunkStore:
    """Chunks by ``chunk_id`` under a path: ``b<n>`` is a whole version, ``d<n>`` the rows of one upsert after it."""

    MAX_DELTAS = 8

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _files(self):
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return base, base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _all(self) -> list[tuple[int, str]]:
        """All complete versions, in order."""
        base, fs = self._files()
        if not fs.exists(base):
            return []
        done = [s.getPath() for s in fs.listStatus(base) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        names = [p.getName() for p in done]
        return sorted((int(n[1:]), n) for n in names if n[:1] in "bd" and n[1:].isdigit())

    def _versions(self) -> list[str]:
        """The last whole version and what came after it."""
        found = self._all()
        first = max((k for k, (_, n) in enumerate(found) if n[0] == "b"), default=0)
        return [n for _, n in found[first:]]

    def version(self) -> str | None:
        """The name of the newest version; it changes with every upsert."""
        found = self._versions()
        return found[-1] if found else None

    def ensure(self, schema) -> None:
        """Create an empty store unless there is one."""
        if not self._all():
            self.spark.createDataFrame([], schema).write.parquet(f"{self.path}/b1")

    def read(self) -> DataFrame:
        names = self._versions()
        rows = self.spark.read.parquet(f"{self.path}/{names[-1]}")
        for name in reversed(names[:-1]):
            older = self.spark.read.parquet(f"{self.path}/{name}")
            rows = older.join(rows.select(self.key), self.key, "left_anti").unionByName(rows, allowMissingColumns=True)
        return rows

    def count(self) -> int:
        return self.read().count()

    def upsert(self, rows: DataFrame) -> int:
        """Insert or replace by key; returns the number of rows given. Doing it twice changes nothing."""
        found = self._all()
        n = (found[-1][0] if found else 0) + 1
        rows.dropDuplicates([self.key]).write.mode("overwrite").parquet(f"{self.path}/{'d' if found else 'b'}{n}")
        if len(self._versions()) > self.MAX_DELTAS:
            self.compact()
        return rows.count()

    def compact(self) -> None:
        """Merge all versions into one; those before the last whole one, which a reader may still use, stay until the next time."""
        found, used = self._all(), self._versions()
        self.read().write.mode("overwrite").parquet(f"{self.path}/b{found[-1][0] + 1}")
        base, fs = self._files()
        for _, name in found:
            if name not in used:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(base, name), True)

    def reset(self) -> None:
        base, fs = self._files()
        fs.delete(base, True)

    def tags(self) -> DataFrame:
        """Distinct tags with their number of chunks."""
        return self.read().select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy("tag")

    def json_rows(self, limit: int = 10) -> list[str]:
        """The first rows by key as JSON, for a look at the store."""
        return [r["value"] for r in self.read().orderBy(self.key).limit(limit).select(F.to_json(F.struct("*")).alias("value")).collect()]
