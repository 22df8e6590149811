"""Request logs: shaping, the ring of recent rows, and prompt history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.config import DEFAULTS

TIMES = ["total_ms", "embed_ms", "search_ms", "rerank_ms", "llm_ms", "intro_ms", "extractor_ms"]
LOG_SCHEMA = T.StructType(
    [T.StructField("type", T.StringType()), *(T.StructField(t, T.DoubleType()) for t in TIMES), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()), T.StructField("ts", T.DoubleType())]
)


def entries(rows: DataFrame) -> DataFrame:
    """Rows with times rounded to whole milliseconds, halves to even."""
    return rows.withColumns({t: F.bround(t, 0) for t in TIMES if t in rows.columns})


def entry_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row, without the fields that are null."""
    return entries(rows).select(F.to_json(F.struct("*")).alias("value"))


def token_total(intro: Column, extractor: Column) -> Column:
    """Sum of two token counts; 0 is null."""
    return F.nullif(F.coalesce(intro, F.lit(0)) + F.coalesce(extractor, F.lit(0)), F.lit(0))


def usage_tokens(response: Column) -> tuple[Column, Column]:
    """(input, output) tokens in the usage field of a JSON response; null where there are none or no numbers."""

    def number(*names: str) -> Column:
        found = [F.get_json_object(response, f"$.{top}.{n}") for top in ("usage_metadata", "usageMetadata") for n in names]
        return F.coalesce(*found).try_cast("long")

    return number("prompt_token_count", "promptTokenCount"), number("candidates_token_count", "candidatesTokenCount")


def trimmed(rows: DataFrame, time: str, tie: str, keep: int = DEFAULTS.log_rows) -> DataFrame:
    """What a log keeps when it is loaded: its latest rows, oldest first."""
    return recent(rows, time, tie, keep).orderBy(time, tie)


def recent(rows: DataFrame, time: str, tie: str, keep: int = DEFAULTS.log_rows) -> DataFrame:
    """The latest rows, newest first; a top-k, not a sort of all rows."""
    return rows.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(keep)


def prompt_history(rows: DataFrame, user: str, query: str, time: str, keep: int = 10) -> DataFrame:
    """The latest use of each query of a user, at most ``keep`` a user, with its place (1 is the newest)."""
    latest = rows.groupBy(user, query).agg(F.max(time).alias(time))
    order = Window.partitionBy(user).orderBy(F.col(time).desc(), query)
    return latest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
