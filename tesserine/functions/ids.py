"""Identifiers and pseudo-embeddings from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def chunk_id(path: Column, start: Column, end: Column, snippet: Column) -> Column:
    """32 hexadecimal digits that name a chunk by place and content."""
    place = F.concat_ws("|", _text(path), _text(start), _text(end))
    return F.substring(F.sha2(F.concat(place, F.lit("\n"), _text(snippet)), 256), 1, 32)


def parent_id(path: Column, start: Column, end: Column, snippet: Column) -> Column:
    """24 hexadecimal digits that name a chunk as the parent of its summary."""
    return F.substring(F.sha2(F.concat_ws("|", _text(path), _text(start), _text(end), _text(snippet)), 256), 1, 24)


def cache_id(path: Column, start: Column, end: Column, snippet: Column) -> Column:
    """64 hexadecimal digits that name a chunk in a cache by place and content."""
    return F.sha2(F.concat_ws("|", _text(path), _text(start), _text(end), _text(snippet)), 256)


def pseudo_embedding(text: Column, dim: int = 768) -> Column:
    """32 values between -0.1 and 0.1 from the eight words of the digest, four times over, and zeros up to ``dim``."""
    digest = F.sha2(_text(text), 256)
    word = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") * 0.2 / 4294967296.0 - 0.1
    words = F.array(*(word(i) for i in range(8)))
    return F.slice(F.concat(words, words, words, words, F.array_repeat(F.lit(0.0), max(0, dim - 32))), 1, dim)
