"""Defaults of the engine; a field can be overridden through ``spark.tesserine.<field>``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    max_chunk_lines: int = 45
    window_lines: int = 45
    overlap_lines: int = 0
    query_candidates: int = 50
    query_final: int = 25
    chat_candidates: int = 30
    chat_final: int = 8
    max_per_file: int = 2
    snippet_lines: int = 20
    score_threshold: float = 0.0
    min_vector_score: float = 0.15
    rrf_k: int = 60
    bm25_min_score: float = 1e-9
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    prefetch_candidates: int = 20
    prefetch_final: int = 6
    prefetch_ttl_s: int = 120
    prefetch_cooldown_s: int = 15
    prefetch_min_length: int = 12
    prefetch_debounce_ms: int = 1800
    rerank_max: int = 6
    rerank_gap: float = 0.02
    rerank_timeout_ms: int = 350
    embedding_dim: int = 768
    embed_batch_tokens: int = 18_000
    max_file_mb: int = 2
    payload_chars: int = 65_535
    log_rows: int = 200

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Defaults with what the session overrides."""
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"spark.tesserine.{f.name}", None)
            if value is not None:
                found[f.name] = type(f.default)(value)
        return replace(cls(), **found)


DEFAULTS = Settings()
