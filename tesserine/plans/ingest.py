"""Ingestion as one plan: files, chunks, enrichment, vectors and postings."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.config import DEFAULTS, Settings
from tesserine.functions import code, ids, paths, tags, text
from tesserine.operators import bm25, embedding
from tesserine.operators.chunking import chunk_files
from tesserine.sources import discovery
from tesserine.sources.index_store import IndexStore
from tesserine.sources.store import ChunkStore

Summaries = Callable[[DataFrame], DataFrame]


def heuristic_summaries(chunks: DataFrame) -> DataFrame:
    """The default provider: a summary from what is known of a chunk."""
    name = F.coalesce(F.nullif(F.col("function_name"), F.lit("")), F.col("paragraph_name"))
    return chunks.withColumn("summary_text", text.three_sentences(text.heuristic_summary(name, F.col("phase"), F.col("include_headers"), F.col("file_ext"))))


def provided_summaries(provider: embedding.Provider, cache: embedding.EmbeddingCache) -> Summaries:
    """Summaries by a provider of (sha, summary_text), for instance ``providers.remote``; where it gives none, the default ones."""

    def summaries(chunks: DataFrame) -> DataFrame:
        asked = heuristic_summaries(chunks).withColumnRenamed("summary_text", "__instead")
        found = embedding.answered(asked, cache, provider, "code_snippet")
        own = text.three_sentences(F.col("summary_text"))
        return found.withColumn("summary_text", F.when(F.trim(F.coalesce("summary_text", F.lit(""))) != "", own).otherwise(F.col("__instead"))).drop("__instead")

    return summaries


def enriched(files: DataFrame, chunks: DataFrame, summaries: Summaries = heuristic_summaries, settings: Settings = DEFAULTS) -> DataFrame:
    """Stored rows: chunks of ``files`` with path parts, phase, headers, summary, prefix and ids."""
    headers = files.select("file", code.include_headers(F.col("text")).alias("include_headers"))
    rows = chunks.join(headers, "file").withColumnRenamed("file", "file_path")
    path = F.col("file_path")
    rows = rows.withColumns(
        {
            "file_dir": paths.directory(path),
            "file_name": paths.stem(path),
            "folder": paths.folder(path),
            "phase": paths.phase(paths.phase_haystack(path, F.col("function_name"), F.col("paragraph_name"), F.col("tags"))),
            "chunk_id": ids.chunk_id(path, F.col("start_line"), F.col("end_line"), F.col("code_snippet")),
            "parent_id": ids.parent_id(path, F.col("start_line"), F.col("end_line"), F.col("code_snippet")),
        }
    )
    prefix = tags.metadata_prefix(
        phase=F.col("phase"), program=F.col("program_id"), division=F.col("division"), section=F.col("section_name"), paragraph=F.col("paragraph_name"),
        name=F.col("file_name"), start=F.col("start_line"), end=F.col("end_line"), tags=F.col("tags"),
    )
    return summaries(rows).withColumns({"chunk_type": F.lit("child_summary"), "retrieval_parent_id": F.col("parent_id"), "metadata_prefix": prefix})


def retrieval_text(chunks: DataFrame, index_code: bool = False) -> DataFrame:
    """``chunks`` with the text that is embedded and indexed: prefix and summary, or with ``index_code`` the whole code."""
    summary = F.lit(None).cast("string") if index_code else F.col("summary_text")
    return chunks.withColumn("retrieval_text", tags.retrieval_text(F.col("metadata_prefix"), summary, F.col("code_snippet")))


def ingest_files(files: DataFrame, store: ChunkStore, index_path: str | None, summaries: Summaries = heuristic_summaries, provider: embedding.Provider | None = None, index_code: bool = False, cache: embedding.EmbeddingCache | None = None, settings: Settings = DEFAULTS) -> tuple[int, int]:
    """Upsert ``files`` (file, text) and, with ``index_path``, bring the index up to date; (files with chunks, chunks)."""
    chunks = chunk_files(files, cap=settings.max_chunk_lines, window=settings.window_lines, overlap=settings.overlap_lines)
    rows = retrieval_text(enriched(files, chunks, summaries, settings), index_code)
    # What is stored is cut; what is embedded and indexed is not.
    rows = rows.withColumn("code_snippet", F.substring("code_snippet", 1, settings.payload_chars))
    # Without a cache, vectors are kept beside the store until its rows are written, so that no text is asked for twice.
    vectors = cache or embedding.EmbeddingCache(store.spark, f"{store.path}-vectors-{uuid.uuid4().hex}")
    instead = ids.pseudo_embedding(F.col("retrieval_text"), settings.embedding_dim)
    rows = embedding.answered(rows, vectors, provider or embedding.pseudo_provider(settings.embedding_dim), "retrieval_text", instead).persist()
    n_files, n_chunks = rows.select("file_path").distinct().count(), store.upsert(rows)
    if index_path is not None:
        update_index(store, rows, index_path)
    rows.unpersist()
    if cache is None:
        vectors.drop()
    return n_files, n_chunks


def update_index(store: ChunkStore, rows: DataFrame, index_path: str) -> None:
    """Bring the index up to date with ``rows``, which the store has just taken; one that is not there yet is built of the whole store."""
    kept = IndexStore(store.spark, index_path)
    if kept.versions():
        kept.upsert(rows, "chunk_id", "retrieval_text")
    else:
        kept.write(bm25.build_index(store.read(), "chunk_id", "retrieval_text"))


def ingest(spark: SparkSession, root: str, store_path: str, extensions: str = "*", max_files: int | None = None, reset: bool = False, **options) -> tuple[int, int]:
    """Ingest a folder tree; with ``reset`` into an empty store. Paths are stored below the name of ``root``."""
    store = ChunkStore(spark, f"{store_path}/chunks")
    if reset:
        reset_store(spark, store_path)
    found = discovery.discover(spark, root, discovery.extension_list(extensions))
    return ingest_files(discovery.read_text(found, max_files), store, f"{store_path}/index", **options)


def reset_store(spark: SparkSession, store_path: str) -> None:
    """Drop chunks and index."""
    ChunkStore(spark, f"{store_path}/chunks").reset()
    IndexStore(spark, f"{store_path}/index").reset()


def reingest(spark: SparkSession, root: str, store_path: str, **options) -> dict[str, object]:
    """Ingest ``root``, or a folder of its name inside it if there is no such folder, into an empty store; a report."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    is_dir = lambda p: fs.exists(path(p)) and fs.getFileStatus(path(p)).isDirectory()
    if not is_dir(root):
        inner = f"{root.rstrip('/')}/{root.rstrip('/').rsplit('/', 1)[-1]}"
        if not is_dir(inner):
            raise ValueError(f"{root} is not a folder")
        root = inner
    files, chunks = ingest(spark, root, store_path, reset=True, **options)
    return {"status": "ok", "files_ingested": files, "chunks_upserted": chunks, "total_chunks": ChunkStore(spark, f"{store_path}/chunks").count(), "code_root": root, "code_extensions": options.get("extensions", "*"), "max_files": options.get("max_files")}


def status(spark: SparkSession, store_path: str, settings: Settings = DEFAULTS) -> dict[str, object]:
    """Settings in force, where the store is and how many chunks it has."""
    store = ChunkStore(spark, f"{store_path}/chunks")
    version = store.version()
    return {**asdict(settings), "storage_path": store.path, "point_count": store.count() if version else 0, "version": version, "status": "ok" if version else "empty"}
