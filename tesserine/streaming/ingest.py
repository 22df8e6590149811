"""Micro-batched ingestion and log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.config import DEFAULTS
from tesserine.operators.logs import LOG_SCHEMA, entries, entry_json
from tesserine.plans.ingest import ingest_files
from tesserine.sources import discovery
from tesserine.sources.store import ChunkStore


def source_files(spark: SparkSession, root: str, extensions: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """A stream of (file, text) of the files that appear below ``root``, admitted and named as in a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    return discovery.read_text(discovery.admitted(stream, discovery.qualified(spark, root), discovery.extension_list(extensions)))


def start_ingest(files: DataFrame, store_path: str, checkpoint: str, **options):
    """Upsert each micro-batch into store and index; one that is repeated after a failure changes nothing."""

    def flush(batch: DataFrame, _: int) -> None:
        ingest_files(batch, ChunkStore(batch.sparkSession, f"{store_path}/chunks"), f"{store_path}/index", **options)

    return files.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(files: DataFrame, store_path: str, checkpoint: str, **options) -> int:
    """Ingest all that is there in micro-batches; the number of chunks."""
    start_ingest(files, store_path, checkpoint, **options).awaitTermination()
    return ChunkStore(files.sparkSession, f"{store_path}/chunks").count()


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of request-log rows."""
    return spark.readStream.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path).withColumn("time", F.timestamp_seconds("ts"))


def start_log_sink(rows: DataFrame, path: str, checkpoint: str):
    """Append rows as JSON lines, exactly once."""
    return entry_json(rows).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class BoundedLog:
    """The newest ``keep`` rows of any number of streams.

    Each stream keeps its own newest rows as one small table, of which a micro-batch
    writes the next version; a reader takes the last version of each stream and of
    these the newest rows.  A batch that is run again writes its version again.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = DEFAULTS.log_rows):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _versions(self, stream: str) -> list[int]:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{stream}")
        fs = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        done = [s.getPath() for s in fs.listStatus(base) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def add(self, rows: DataFrame, stream: str, batch: int) -> None:
        """Take in the micro-batch ``batch`` of ``stream``; what is before the version it builds on goes."""
        before = [v for v in self._versions(stream) if v < batch]
        rows = entries(rows).select(*(f.name for f in LOG_SCHEMA))
        if before:
            rows = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/{stream}/v{before[-1]}").unionByName(rows)
        # The whole row breaks ties of time, so a batch that is run again keeps the same rows.
        newest = rows.orderBy(F.col("ts").desc(), *LOG_SCHEMA.fieldNames()).limit(self.keep)
        newest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{stream}/v{batch}")
        for version in before[:-1]:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{stream}/v{version}")
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def start(self, rows: DataFrame, stream: str, checkpoint: str):
        """Keep the newest rows of a stream; ``stream`` names it, also after a restart with its checkpoint."""
        return rows.writeStream.foreachBatch(lambda batch, n: self.add(batch, stream, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        """The newest rows of all streams, oldest first."""
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        streams = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
        last = [f"{self.path}/{s}/v{found[-1]}" for s in streams if (found := self._versions(s))]
        rows = self.spark.read.schema(LOG_SCHEMA).parquet(*last) if last else self.spark.createDataFrame([], LOG_SCHEMA)
        return rows.orderBy(F.col("ts").desc(), *LOG_SCHEMA.fieldNames()).limit(self.keep).orderBy("ts")
