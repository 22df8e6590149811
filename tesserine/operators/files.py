"""Views of files and of stored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions import paths
from tesserine.operators.needles import holding


#: Keys that are sent to all tasks, in rows.
MOST_KEYS = 1 << 20


def rows_of(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among those of ``keys``, a persisted result of a search.

    Keys go to where the rows are read, so texts that no result has are not shuffled;
    too many of them are joined.
    """
    wanted = keys.select(key).distinct()
    return rows.join(F.broadcast(wanted) if keys.count() <= MOST_KEYS else wanted, key, "left_semi")


def chunk_page(chunks: DataFrame, limit: int, after=None, contains: str | None = None, source_type: str | None = None, filter_after_paging: bool = False) -> DataFrame:
    """One page of chunks in the order of their id, by key instead of by offset.

    By default filters come first, so a page is full as long as there are rows;
    with ``filter_after_paging`` they come last, as in the service.
    """
    wanted = F.lit(True)
    if contains:
        wanted = wanted & F.col("file_path").contains(contains)
    if source_type and source_type != "all":
        wanted = wanted & (F.col("source_type") == source_type)
    if not filter_after_paging:
        chunks = chunks.where(wanted)
    if after is not None:
        chunks = chunks.where(F.col("chunk_id") > after)
    page = chunks.orderBy("chunk_id").limit(min(limit, 200))
    return page.where(wanted) if filter_after_paging else page


def chunks_of(chunks: DataFrame, path: str | Column) -> DataFrame:
    """Chunks of one file, in order."""
    return chunks.where(F.col("file_path") == path).orderBy("start_line")


def found_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, path): for each wanted name the first path that is it, has it as its last parts, or has it as its base name.

    Joined on the base name, which all three have in common.
    """
    asked = wanted.select("name").distinct().where(paths.is_safe(F.col("name")) & (F.length("name") > 0)).withColumn("base", paths.base_name(F.col("name")))
    stored = files.select("path", paths.base_name(F.col("path")).alias("base"))
    met = stored.join(asked, "base").where((F.col("path") == F.col("name")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("name"))))
    return met.groupBy("name").agg(F.min("path").alias("path"))


def _snippet_lines(chunks: DataFrame) -> DataFrame:
    rows = chunks.select("file_path", "start_line", "end_line", F.posexplode(F.split("code_snippet", "\n", -1)).alias("i", "line"))
    return rows.withColumn("line_no", F.col("start_line") + F.col("i"))


def line_ranges(chunks: DataFrame, first: Column, last: Column) -> DataFrame:
    """(file_path, text, total_lines): lines of a range put together from chunks; of chunks that overlap the first counts, gaps are left out."""
    totals = chunks.groupBy("file_path").agg(F.max("end_line").alias("total_lines"))
    rows = _snippet_lines(chunks).where((F.col("line_no") >= first) & (F.col("line_no") <= last))
    once = rows.groupBy("file_path", "line_no").agg(F.min_by("line", "start_line").alias("line"))
    return once.groupBy("file_path").agg(_joined("line_no", "line").alias("text")).join(totals, "file_path")


def _joined(order: str, value: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return F.array_join(F.transform(rows, lambda r: r[value]), "\n")


def full_files(chunks: DataFrame) -> DataFrame:
    """(file_path, text, total_lines): whole files from chunks; of chunks that overlap the last counts, gaps are empty lines."""
    totals = chunks.groupBy("file_path").agg(F.max("end_line").alias("total_lines"))
    known = _snippet_lines(chunks).groupBy("file_path", "line_no").agg(F.max_by("line", "start_line").alias("line"))
    numbers = totals.select("file_path", "total_lines", F.explode(F.sequence(F.lit(1), "total_lines")).alias("line_no"))
    filled = numbers.join(known, ["file_path", "line_no"], "left").withColumn("line", F.coalesce("line", F.lit("")))
    return filled.groupBy("file_path", "total_lines").agg(_joined("line_no", "line").alias("text"))


def widened(start: Column, end: Column, total: Column, by: int = 10) -> tuple[Column, Column]:
    """A line range with ``by`` more lines on either side, inside the file."""
    return F.greatest(F.lit(1), start - by), F.least(total, end + by)


def file_range(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Lines ``start`` to ``end`` (from 1, both included, clamped) of one file of ``files`` (file, text); empty if they cross."""
    from tesserine.functions.text import lines

    body = lines(F.col("text"))
    low = max(1, start)
    part = F.when(F.lit(low <= end), F.array_join(F.slice(body, low, max(0, end - low + 1)), "\n")).otherwise("")
    return files.where((F.col("file") == path) & paths.is_safe(F.col("file"))).select("file", part.alias("text"), F.size(body).alias("total_lines"))


def doc_chunks(chunks: DataFrame, wanted: DataFrame, top_k: int) -> DataFrame:
    """The first ``top_k`` chunks, by line, of the files whose path contains the wanted name (query_id, name), in any case.

    All distinct names are looked for at once in each distinct path (``needles``).
    Chunks are put in order by their places; the rest of them is read at the end.
    """
    asked = wanted.where("name is not null").select("query_id", F.lower("name").alias("__name"))
    first = lambda rows, key: rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("start_line", "file_path", "chunk_id"))).where(F.col("rank") <= top_k)
    places = holding(chunks.select("file_path").distinct().withColumn("__low", F.lower("file_path")), "__low", asked, "__name").drop("__low")
    met = chunks.select("file_path", "start_line", "chunk_id").join(places, "file_path")
    found = first(first(met, "__name").drop("rank").join(asked, "__name").drop("__name"), "query_id").select("query_id", "chunk_id", "rank").persist()
    return found.join(rows_of(found, chunks.drop("query_id"), "chunk_id"), "chunk_id")
