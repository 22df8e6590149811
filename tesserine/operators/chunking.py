"""Chunking of files into line ranges, by windows over (file, line number).

All operators take a frame of lines (``file``, ``line_no`` from 1, ``line``)
or of files, so files of any number run in one plan; nothing is partitioned by
more than a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.config import DEFAULTS
from tesserine.functions import paths, tags, text

DIVISION = r"^(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)( DIVISION.*|\.)$"


def lines_of(files: DataFrame, file: str = "file", body: str = "text") -> DataFrame:
    """One row a line: all other columns, line_no and line."""
    rest = [c for c in files.columns if c != body]
    return files.select(*rest, F.posexplode(text.lines(F.col(body))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def is_paragraph(line: Column) -> Column:
    """Whether a fixed-format line starts a paragraph: text from column 8 to 12, a period at the end behind it, no division, no level number, no comment.

    Section headers count, except those with several words before SECTION.
    """
    upper, area = F.upper(line), F.substring(line, 8, 1 << 20)
    ended = F.regexp_replace(F.regexp_replace(area, r"\s+$", ""), r"\.+$", "")
    before_section = F.trim(F.substring_index(F.upper(ended), " SECTION", 1))
    wordy = upper.contains(" SECTION") & F.upper(ended).contains(" SECTION") & before_section.contains(" ")
    # The area is five characters long, so it takes in the first of the next one.
    in_area = F.trim(F.substring(line, 8, 5)) != ""
    rest = F.regexp_replace(F.substring(line, 13, 1 << 20), r"\s+$", "")
    comment = (F.trim(F.substring(line, 1, 7)) != "") & F.substring(line, 7, 1).isin("*", "!", "/")
    return (F.length(line) >= 12) & ~upper.contains(" DIVISION") & ~wordy & in_area & rest.endswith(".") & ~paragraph_name(line).rlike(r"^\d{1,2}$") & ~comment


def paragraph_name(line: Column) -> Column:
    """First word from column 8, without the period that ends the line."""
    area = F.regexp_replace(F.regexp_replace(F.substring(line, 8, 1 << 20), r"\s+$", ""), r"\.$", "")
    return F.regexp_extract(area, r"^\s*(\S+)", 1)


def division_of(line: Column) -> Column:
    """Name of the division that a header line opens; null for other lines."""
    return F.nullif(F.regexp_extract(F.upper(text.squeeze(line)), DIVISION, 1), F.lit(""))


def program_ids(lines: DataFrame, file: str = "file") -> DataFrame:
    """(file, program_id): the name in the first PROGRAM-ID line between the identification division's header and a line on another division."""
    upper = F.upper(F.trim("line"))
    order = Window.partitionBy(file).orderBy("line_no")
    opens = upper.contains("IDENTIFICATION") & upper.contains("DIVISION")
    closes = ~opens & (upper.contains("ENVIRONMENT") | upper.contains("DATA") | upper.contains("PROCEDURE"))
    rest = F.regexp_replace(F.substring(F.trim("line"), 12, 1 << 20), r"^\.+", "")
    name = F.regexp_replace(F.regexp_extract(rest, r"^\s*(\S+)", 1), r"\.+$", "")
    marked = lines.select(file, "line_no", "line", F.max(opens.cast("int")).over(order).alias("inside"), opens.alias("opens"), closes.alias("closes"))
    marked = marked.withColumn("closed", F.coalesce(F.max(F.when((F.col("inside") == 1) & F.col("closes"), 1)).over(order), F.lit(0)))
    found = marked.where((F.col("inside") == 1) & ~F.col("opens") & (F.col("closed") == 0) & upper.startswith("PROGRAM-ID")).withColumn("name", name).where("name <> ''")
    return found.groupBy(file).agg(F.min_by("name", "line_no").alias("program_id"))


def paragraph_chunks(lines: DataFrame, boundary: Column, division: Column, name: Column, cap: int = DEFAULTS.max_chunk_lines, file: str = "file") -> DataFrame:
    """Chunks that start at boundaries and after ``cap`` lines.

    Division and section of a chunk are those in force once the line after it
    has been looked at for a division, so a division header relabels the chunk
    before it and clears its section.
    """
    order = Window.partitionBy(file).orderBy("line_no")
    marked = lines.select(file, "line_no", "line", boundary.alias("b"), division.alias("d"), F.when(boundary, name).alias("p"))
    marked = marked.withColumns(
        {
            "seg": F.sum(F.col("b").cast("int")).over(order),
            "in_force": F.last("d", ignorenulls=True).over(order),
            # A one-field struct can carry a null: a boundary sets the section, a division clears it.
            "event": F.when(F.col("b"), F.struct(F.col("p").alias("section"))).when(F.col("d").isNotNull(), F.struct(F.lit(None).cast("string").alias("section"))),
        }
    )
    marked = marked.withColumns(
        {
            "section": F.last("event", ignorenulls=True).over(order)["section"],
            "sub": F.floor((F.row_number().over(Window.partitionBy(file, "seg").orderBy("line_no")) - 1) / cap),
            "division_after": F.lead("in_force").over(order),
            "next_division": F.lead("d").over(order),
            "has_next": F.lead("line_no").over(order).isNotNull(),
        }
    )
    at_end = lambda c: F.max_by(c, "line_no")
    first = F.min_by(F.struct("b", "p"), "line_no")
    return (
        marked.groupBy(file, "seg", "sub")
        .agg(
            F.min("line_no").alias("start_line"),
            F.max("line_no").alias("end_line"),
            at_end(F.struct(F.when(F.col("has_next"), F.col("division_after")).otherwise(F.col("in_force")).alias("v")))["v"].alias("division"),
            at_end(F.struct(F.when(F.col("next_division").isNull(), F.col("section")).alias("v")))["v"].alias("section_name"),
            F.when(F.col("sub") == 0, F.when(first["b"], first["p"])).alias("paragraph_name"),
            joined_lines().alias("code_snippet"),
        )
        .drop("seg", "sub")
    )


def joined_lines() -> Column:
    """Aggregate: the lines of a group in order, as one text."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")


def fixed_chunks(files: DataFrame, window: int = DEFAULTS.window_lines, overlap: int = DEFAULTS.overlap_lines, file: str = "file", body: str = "text") -> DataFrame:
    """Windows of ``window`` lines that start every ``window - overlap`` lines; the columns of ``files`` but the text, and start_line, end_line and code_snippet. No shuffle."""
    if overlap >= window:
        raise ValueError("overlap must be less than the window")
    rest = [c for c in files.columns if c != body]
    split = files.select(*rest, text.lines(F.col(body)).alias("__lines"))
    # Each row's windows are made by one generator, so the lines are cut once.
    starts = F.when(F.size("__lines") > 0, F.sequence(F.lit(0), F.size("__lines") - 1, F.lit(window - overlap)))
    windows = F.transform(starts, lambda s: F.struct((s + 1).alias("start_line"), F.least(s + window, F.size("__lines")).alias("end_line"), F.array_join(F.slice("__lines", s + 1, window), "\n").alias("code_snippet")))
    return split.select(*rest, F.inline(windows))


def chunk_files(files: DataFrame, units: DataFrame | None = None, cap: int = DEFAULTS.max_chunk_lines, window: int = DEFAULTS.window_lines, overlap: int = DEFAULTS.overlap_lines) -> DataFrame:
    """Chunks of ``files`` (file, text) by language.

    COBOL is cut at paragraphs, unless that leaves none or one longer than the
    window; C is cut into functions and structs (``units``, see ``c_units``)
    where there are any; all else is cut into windows.
    """
    from tesserine.operators.c_units import c_units

    typed = files.select("file", "text", paths.language(F.col("file")).alias("language"), paths.source_type(F.col("file")).alias("source_type"), paths.extension(F.col("file")).alias("file_ext"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    about = typed.drop("text")

    cobol = typed.where("language = 'COBOL'")
    lines = lines_of(cobol.select("file", "text"))
    programs = program_ids(lines)
    whole = paragraph_chunks(lines, is_paragraph(F.col("line")), division_of(F.col("line")), paragraph_name(F.col("line")), cap)
    per_file = Window.partitionBy("file")
    counted = whole.withColumn("n", F.count(F.lit(1)).over(per_file)).withColumn("last", F.max("end_line").over(per_file))
    kept = counted.where(~((F.col("n") == 1) & (F.col("last") > window))).drop("n", "last").join(programs, "file", "left")
    structural = tags.structural_tags(F.col("division"), F.col("section_name"), F.col("paragraph_name"), F.col("program_id"))
    by_paragraph = kept.withColumn("tags", F.concat(structural, tags.role_tags(F.col("code_snippet")))).withColumns({"function_name": none, "calls_functions": empty, "uses_structs": empty})

    c_files = typed.where("language in ('C', 'C Header')")
    units = c_units(c_files.select("file", "text")) if units is None else units
    by_unit = units.select(
        "file", "start_line", "end_line", none.alias("division"), none.alias("section_name"), F.col("name").alias("paragraph_name"), "code_snippet", none.alias("program_id"),
        tags.c_tags(F.col("kind"), F.col("name")).alias("tags"), F.col("name").alias("function_name"), "calls_functions", "uses_structs",
    )

    done = by_paragraph.select("file").unionByName(by_unit.select("file")).distinct()
    rest = typed.join(done, "file", "left_anti")
    windows = fixed_chunks(rest.select("file", "language", "text"), window, overlap).join(programs, "file", "left")
    program_tag = F.array_compact(F.array(F.concat(F.lit("program:"), F.col("program_id"))))
    roles = F.when(F.col("language").isin("COBOL", "C", "C Header"), tags.role_tags(F.col("code_snippet"))).otherwise(empty)
    by_window = windows.withColumn("tags", F.concat(program_tag, roles)).drop("language").withColumns(
        {"division": none, "section_name": none, "paragraph_name": none, "function_name": none, "calls_functions": empty, "uses_structs": empty}
    )
    columns = by_paragraph.columns
    return by_paragraph.unionByName(by_unit.select(columns)).unionByName(by_window.select(columns)).join(about, "file")
