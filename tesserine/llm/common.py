"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word definition: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Named columns (doc_id and text by default) of the whole documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; where it is unset, a temporary one if driver and executors are one process (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through files in the shared checkpoint folder, which outlive any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch hands to a Python worker by rows and by bytes; the same for all operators, as frames run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Catalyst may inline an aliased expression into a lambda, where it would be
    evaluated again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def id_hash_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def text_key(text: str) -> Column:
    """What tells rows with one id apart: a hash of the text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or the like, that no column of ``docs`` has (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, judged: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judged`` (doc_id, text_key, kept; a row for each of them) keeps, all columns.

    The lost rows are the smaller side, and adaptive execution broadcasts them
    only if they are measured as small.  Of rows that repeat id and text those
    beyond the kept one go as well.  Columns of ``docs`` may have any names.
    """
    name, key, nth = (fresh(docs, n) for n in ("lost_id", "lost_key", "lost_nth"))
    keys = [F.col("doc_id").alias(name), F.col("text_key").alias(key)]
    kept = judged.where("kept").select(*keys)
    lost = judged.where(~F.col("kept")).select(*keys).distinct()
    both = F.col(f"l.{name}").eqNullSafe(F.col(f"k.{name}")) & (F.col(f"l.{key}") == F.col(f"k.{key}"))
    again = checkpoint(lost.alias("l").join(kept.alias("k"), both, "left_semi"))
    same = F.col(name).eqNullSafe(F.col(doc_id)) & (F.col(key) == text_key(text))
    if not again.take(1):
        return docs.join(lost, same, "left_anti")
    gone = lost.alias("l").join(again.alias("k"), both, "left_anti")
    left = docs.join(gone, same, "left_anti")
    one = Window.partitionBy(F.col(doc_id), text_key(text)).orderBy(F.lit(1))
    repeated = left.join(again, same, "left_semi").withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).drop(nth)
    return left.join(again, same, "left_anti").unionByName(repeated)


def slim(df: DataFrame) -> DataFrame:
    """A frame that is small against its input in a quarter of the shuffle partitions, 24 at least, before it is written."""
    return df.coalesce(max(24, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a query that runs inside go as soon as it has ended, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Intermediate tables as Parquet files in the shared checkpoint folder.

    Unlike ``checkpoint`` they are columnar and compressed, and can be dropped
    as soon as the frame that reads them has been written.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def remove(self, *tables: DataFrame) -> None:
        """Delete tables of which all that is needed has been written elsewhere."""
        for table in tables:
            if id(table) in self.paths:
                self._delete(self.paths.pop(id(table))[1])

    def drop(self) -> None:
        """Delete all tables of this scratch folder."""
        self.paths.clear()
        self._delete(self.root)
