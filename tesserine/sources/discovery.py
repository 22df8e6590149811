"""Source files from a folder tree, and JSON-lines inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.config import DEFAULTS
from tesserine.functions import paths
from tesserine.operators.logs import LOG_SCHEMA

# What is never a source file.
EXCLUDED_EXTENSIONS = ["vcxproj", "vcxproj.filters", "sln", "suo", "user", "ncb", "aps", "sdf", "opensdf", "db", "cache"]
EXCLUDED_DIRS = [".git", "node_modules", "__pycache__", ".qdrant_data", "build_windows", "vs2017", "vs2019", "vs2022", ".vs", "x64", "Win32", "Debug", "Release"]
SAMPLE_BYTES = 8192
EVAL_SCHEMA = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("expected_paths", T.ArrayType(T.StringType())),
        T.StructField("source_type", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("chat_top_k", T.IntegerType()),
        T.StructField("answer_must_contain", T.ArrayType(T.StringType())),
        T.StructField("answer_must_not_contain", T.ArrayType(T.StringType())),
    ]
)


def extension_list(text: str | None) -> list[str] | None:
    """Extensions of a comma-separated list, without dots; None (all) if it is blank or ``*``."""
    parts = [p.strip().lstrip(".").lower() for p in (text or "").split(",")]
    found = [p for p in parts if p]
    return None if not found or "*" in found else found


def is_text(content: Column) -> Column:
    """Text or binary by the first bytes: empty is text, a NUL is binary, valid UTF-8 is text, else less than a tenth may be control bytes."""
    sample = F.substring(content, 1, SAMPLE_BYTES)
    latin = F.decode(sample, "ISO-8859-1")
    control = F.length(F.regexp_replace(latin, r"[^\x01-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return (F.length(sample) == 0) | (~F.contains(latin, F.lit("\0")) & (F.is_valid_utf8(sample.cast("string")) | (control / F.length(sample) < 0.10)))


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as Spark's file sources write paths below it."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    return base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")


def admitted(listed: DataFrame, base: str, extensions: list[str] | None = None, excluded_dirs: list[str] | None = None, max_mb: int = DEFAULTS.max_file_mb, text_only: bool = True) -> DataFrame:
    """(file, path, length, is_doc, content) of the files of a listing, batch or stream, that are sources.

    ``file`` is ``<name of the root>/<path below it>``.  Size and names are
    columns of the listing, so they prune before content is read.  Files without
    an extension that are known documentation come with ``is_doc`` and are
    admitted whatever the list says, in any case.  Empty files, which have no
    chunks, are left out.  A listing has each path once, so nothing is shuffled.
    """
    below = F.regexp_replace(F.substring("path", len(base) + 1, 1 << 30), "^/+", "")
    rows = listed.select("path", "length", below.alias("below"), "content")
    ext = paths.extension(F.col("below"))
    banned = F.array(*map(F.lit, EXCLUDED_DIRS if excluded_dirs is None else excluded_dirs))
    doc = ext.isNull() & F.lower(paths.base_name(F.col("below"))).isin(paths.DOC_NAMES)
    wanted = (F.col("length") > 0) & (F.col("length") <= max(1, max_mb) << 20) & ~F.arrays_overlap(F.split("below", "/"), banned) & ~F.coalesce(ext.isin(EXCLUDED_EXTENSIONS), F.lit(False))
    if extensions is not None:
        wanted = wanted & (F.coalesce(ext.isin([e.lstrip(".").lower() for e in extensions]), F.lit(False)) | doc)
    rows = rows.where(wanted)
    if text_only:
        rows = rows.where(is_text(F.col("content")))
    return rows.select(paths.below_root(F.col("path"), base).alias("file"), "path", "length", doc.alias("is_doc"), "content")


def discover(spark: SparkSession, root: str, extensions: list[str] | None = None, excluded_dirs: list[str] | None = None, max_mb: int = DEFAULTS.max_file_mb, text_only: bool = True) -> DataFrame:
    """The admitted files below ``root``, see ``admitted``."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return admitted(listed, qualified(spark, root), extensions, excluded_dirs, max_mb, text_only)


def read_text(found: DataFrame, max_files: int | None = None) -> DataFrame:
    """(file, text), bad bytes replaced; with ``max_files`` documentation first, then by path."""
    if max_files:
        found = found.orderBy(F.col("is_doc").desc(), "file").limit(max_files)
    return found.select("file", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def eval_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an evaluation set; blank lines are skipped."""
    return spark.read.schema(EVAL_SCHEMA).json(path).where(F.trim("query") != "")


def request_logs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a request log; malformed lines are skipped."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path).withColumn("time", F.timestamp_seconds("ts"))
