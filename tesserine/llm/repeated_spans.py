"""Removal of byte strings that occur twice or more (suffix-array deduplication).

A string of ``threshold`` bytes is a duplicate if it starts anywhere else.
That is what neighbours in a suffix array with a common prefix of that length
show; here it is found by distributed prefix doubling, without the array.
Positions are ranked by strings of growing length.  The rank of a string of 2k
bytes is made of the ranks at its position and at the offset k (``Hasher``);
Spark sorts and counts the ranks, a position whose rank is unique drops out,
and the others are ranked again until they are unique or past the threshold.

Two things make it affordable at scale.

*   Ranks are 64-bit names of the pairs instead of dense integers, so a round
    needs no global renumbering; a rank is computed from the text where it stands.
*   Positions are handled as runs.  Of the strings of ``core`` bytes inside a
    string of the threshold's length, the leftmost one with the least name is
    its anchor.  Equal strings have equal anchors at equal offsets, and
    consecutive positions share an anchor, so about one row in
    (threshold - core) / 2 bytes stands for all positions.  A run is ranked by
    its core (what all its strings have in common) and by its span (their union):

    - core unique: none of its strings is a duplicate, the run drops out;
    - span repeated: all are duplicates, the run is decided;
    - otherwise it is cut into shorter runs, whose cores are longer (a quarter
      of the threshold first, then all but 15 bytes, then all), and ranked again.

``remove_repeated_spans(digest=True)`` does this at half the threshold, and
then at the threshold for the positions p that are left with p + threshold / 2
(both halves repeat); from the first of the two comes ``n_passages``.

Each round is a scan of the texts that still have undecided runs, an
aggregation with map-side combination and a join with the repeated cores,
which is written first: both sides of the join are then plain exchanges, which
skew handling may split, so a passage that a third of all documents share is no
hot task.  The number of rows is linear in the number of bytes.  Texts of more
than ``SEGMENT`` bytes are ranked in pieces that overlap.

Defined results: a null text is empty, and one shorter than the threshold has
no duplicates; repeated rows are copies of each other; a null doc_id is kept;
a column that has the name of a result is replaced by it, others pass through.
Two different strings are taken for equal only if they have equal cores and
their spans have the same 64-bit name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.llm.blocks import Hasher, text_blocks
from tesserine.llm.common import Scratch, bound_batches, checkpoint, slim

THRESHOLD = 400
#: Positions in a run after the first round and after the second.
RUNS = (16, 1)
#: Words of a repeated passage that counts in ``n_passages``.
PASSAGE_WORDS = 50
SEGMENT = 1 << 20
POSITION_BITS = 22

_hashers: list[Hasher] = []


def hasher() -> Hasher:
    if not _hashers:
        _hashers.append(Hasher(11))
    return _hashers[0]


def segments(column: pa.Array, threshold: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, bytes, offsets, place in the text) of blocks of texts; of a long text, pieces that share no position of a string."""
    for i, j, data, offsets in text_blocks(column):
        if len(data) < SEGMENT + threshold:
            yield i, j, data, offsets, 0
            continue
        for at in range(0, len(data) - threshold + 1, SEGMENT):
            part = data[at : at + SEGMENT + threshold - 1]
            yield i, j, part, np.array([0, len(part)]), at


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i that has so many, in two passes over blocks of ``width``."""
    n = len(x)
    if n < width:
        return x[:0]
    full = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored_runs(data: np.ndarray, offsets: np.ndarray, threshold: int, core: int, allowed: np.ndarray | None = None):
    """Runs of all (allowed) positions of a block: text number, anchor, first and last position (in the block), core and span names."""
    n = len(data)
    if n < threshold:
        return None
    # A position counts if its string ends inside its text.
    sizes = np.diff(offsets)
    usable = np.maximum(sizes - threshold + 1, 0)
    text = np.repeat(np.arange(len(sizes)), usable)
    position = np.arange(len(text)) + (offsets[:-1] - np.cumsum(usable) + usable)[text]
    if allowed is not None:
        good = allowed[position]
        text, position = text[good], position[good]
    if not len(text):
        return None
    names = hasher()
    ladder = enumerate(names.levels(names.table[data]))
    for k, level in ladder:
        if 2 << k > core:
            break
    at = np.arange(n - core + 1)
    h = names.at_level(level, k, at, at + core)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = sliding_min((h & ~mask) | at.astype(np.uint64), threshold - core + 1)
    anchor = (least & mask).astype(np.int64)[position]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (position[1:] != position[:-1] + 1)]))
    low, high = position[new], position[np.append(new[1:], len(text)) - 1]
    span = np.empty(len(new), np.uint64)
    size = np.frexp((high - low + threshold).astype(np.float64))[1] - 1
    while True:
        own = np.flatnonzero(size == k)
        if len(own):
            span[own] = names.at_level(level, k, low[own], high[own] + threshold)
        if k >= int(size.max()):
            break
        k, level = next(ladder)
    return text[new], anchor[new], low, high, h[anchor[new]], span


RUN = "row long, anchor int, low int, high int, core long, span long"


def _run_batch(row, anchor, low, high, core, span) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(row, np.int64)), *(pa.array(x.astype(np.int32)) for x in (anchor, low, high)), *(pa.array(x.view(np.int64)) for x in (core, span))],
        ["row", "anchor", "low", "high", "core", "span"],
    )


def _lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of an array column of integer structs; null is empty."""
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = column.flatten()
    return bounds, [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(flat.type.num_fields)]


def both_halves(low: np.ndarray, high: np.ndarray, size: int, half: int) -> np.ndarray:
    """Of positions in the intervals (half a string repeats there), those that have another ``half`` bytes on."""
    step = np.zeros(size + half + 1, np.int32)
    np.add.at(step, low, 1)
    np.add.at(step, high + 1, -1)
    inside = np.cumsum(step) > 0
    return inside[:size] & inside[half : half + size]


def first_runs(texts: DataFrame, threshold: int, core: int) -> DataFrame:
    """The runs of the first round; if ``texts`` has ``spans`` (low, high), of positions where both halves repeat."""
    halved = "spans" in texts.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            bounds, pairs = _lists(batch.column("spans")) if halved else (None, [])
            for i, j, data, offsets, at in segments(batch.column("text"), threshold):
                allowed = None
                if halved:
                    base = np.repeat(offsets[: j - i], np.diff(bounds[i : j + 1])) - at
                    low, high = (x[bounds[i] : bounds[j]] + base for x in pairs)
                    near = (high >= 0) & (low < len(data) + threshold)
                    allowed = both_halves(np.maximum(low[near], 0), np.minimum(high[near], len(data) + threshold // 2 - 1), len(data), threshold // 2)
                if (found := anchored_runs(data, offsets, threshold, core, allowed)) is not None:
                    text, anchor, low, high, c, s = found
                    base = offsets[text] - at
                    yield _run_batch(rows[i:j][text], anchor - base, low - base, high - base, c, s)

    return texts.select("row", "text", *(["spans"] if halved else [])).mapInArrow(scan, RUN)


def shorter_runs(texts: DataFrame, undecided: DataFrame, threshold: int, width: int) -> DataFrame:
    """Undecided runs cut at offsets from their anchor that are multiples of ``width``."""
    lists = undecided.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("low", "high", "anchor"))).alias("runs"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = hasher()
        for batch in batches:
            rows = batch.column("row").to_numpy()
            bounds, fields = _lists(batch.column("runs"))
            for i, j, data, offsets in text_blocks(batch.column("text")):
                of = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
                low, high, anchor = (f[bounds[i] : bounds[j]] for f in fields)
                # Offsets back from the anchor, in pieces [k * width, (k + 1) * width).
                k0, k1 = (anchor - high) // width, (anchor - low) // width
                count = k1 - k0 + 1
                run = np.repeat(np.arange(len(of)), count)
                k = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + k0[run]
                a, base = anchor[run], offsets[of[run]]
                lo, hi = np.maximum(low[run], a - (k + 1) * width + 1), np.minimum(high[run], a - k * width)
                start = a - k * width
                # All of a run is in [low, low + 2 * threshold); long texts are named piece by piece.
                place = (base + low[run]) // SEGMENT if len(data) >= SEGMENT + threshold else np.zeros(len(run), np.int64)
                for piece in np.unique(place):
                    own = np.flatnonzero(place == piece)
                    begin = int(piece) * SEGMENT
                    values = names.table[data[begin : begin + SEGMENT + 3 * threshold]]
                    b = base[own] - begin
                    first = b + start[own]
                    core, span = np.split(names.spans(values, np.concatenate([first, b + lo[own]]), np.concatenate([first - width + 1 + threshold, b + hi[own] + threshold])), 2)
                    yield _run_batch(rows[i:j][of[run[own]]], a[own], lo[own], hi[own], core, span)

    return texts.join(lists, "row").select("row", "text", "runs").mapInArrow(scan, RUN)


def judge(runs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(decided: row, low, high of duplicate positions; runs to rank again), both tables.

    Of runs with a shared core but several spans, one of each span goes on: as
    undecided if it is the only one, else as a witness that strings of the
    undecided ones can be equal to.
    """
    runs = scratch.table(runs)
    cores = runs.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("s0"), F.max("span").alias("s1")).where("n > 1")
    cores = scratch.table(slim(cores.select("core", (F.col("s0") == F.col("s1")).alias("same"))))
    met = scratch.table(runs.join(cores, "core"))
    scratch.remove(runs, cores)
    mixed = met.where(~F.col("same"))
    run = F.struct("row", "anchor", "low", "high")
    spans = scratch.table(slim(mixed.groupBy("core", "span").agg(F.count(F.lit(1)).alias("n"), F.min(run).alias("run"))))
    repeated = mixed.join(spans.where("n > 1").select("core", "span"), ["core", "span"], "left_semi")
    columns = ["row", "low", "high"]
    decided = scratch.table(met.where("same").select(columns).unionByName(repeated.select(columns)))
    again = scratch.table(slim(spans.select("run.*")))
    scratch.remove(met, spans)
    return decided, again


def duplicate_positions(texts: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> DataFrame:
    """(row, spans: low, high), intervals of positions at which a duplicate string starts, of the texts that have any.

    ``texts`` has row and text, and maybe spans (see ``first_runs``).
    """
    decided, undecided = judge(first_runs(texts, threshold, threshold // 4), scratch)
    parts = [decided]
    for width in RUNS:
        before = undecided
        decided, undecided = judge(shorter_runs(texts, before, threshold, width), scratch)
        parts.append(decided)
        scratch.remove(before)
    scratch.remove(undecided)
    found = reduce(DataFrame.unionByName, parts)
    out = scratch.table(slim(found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))))
    scratch.remove(*parts)
    return out


def covered_spans(low: np.ndarray, high: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Maximal covered byte runs of strings that start in the intervals."""
    if not len(low):
        return []
    order = np.argsort(low, kind="stable")
    low, end = low[order], np.maximum.accumulate(high[order] + threshold)
    new = np.concatenate([[True], low[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return list(zip(low[at].tolist(), end[np.append(at[1:], len(low)) - 1].tolist(), strict=True))


def passages(raw: bytes, spans: list[tuple[int, int]], least_words: int) -> list[tuple[int, int]]:
    """The spans that have so many words."""
    return [(a, b) for a, b in spans if len(raw[a:b].split()) >= least_words] if least_words else spans


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shortened so that no character is cut."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    rest, at = [], 0
    for a, b in spans:
        rest.append(raw[at:a])
        at = b
    return b"".join([*rest, raw[at:]])


def _numbered(docs: DataFrame, text: str, scratch: Scratch, *more) -> DataFrame:
    return scratch.table(docs.select(*more, F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()))


def span_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passages of every row.

    ``n_passages`` are the maximal runs of at least ``least_words`` words that
    strings of half the threshold cover which start anywhere else.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    table = _numbered(docs, text, scratch, F.col(doc_id).alias("doc_id"))
    half = threshold // 2
    halves = duplicate_positions(table.select("row", "text"), scratch, half)
    left = scratch.table(table.select("row", "text").join(halves, "row"))
    scratch.remove(halves)
    whole = duplicate_positions(left, scratch, threshold) if 2 * half == threshold else duplicate_positions(table.select("row", "text"), scratch, threshold)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            texts = batch.column("text").cast(pa.binary())
            found = [_lists(batch.column(c)) for c in ("spans", "whole")]
            for i in range(batch.num_rows):
                raw = texts[i].as_py()
                some, all_ = (covered_spans(*(x[b[i] : b[i + 1]] for x in f), t) for (b, f), t in zip(found, (half, threshold), strict=True))
                kept = without(raw, all_)
                for k, v in enumerate((len(raw) - len(kept), len(all_), hashlib.sha256(kept).hexdigest(), len(passages(raw, some, least_words)))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["row", "n_removed", "n_spans", "sha", "n_passages"])

    found = left.join(whole.withColumnRenamed("spans", "whole"), "row", "left").select("row", "text", "spans", "whole")
    found = scratch.table(found.mapInArrow(cut, "row long, n_removed long, n_spans long, sha string, n_passages long"))
    body = F.coalesce("text", F.lit(""))
    slim_rows = table.select("row", "doc_id", F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha256"))
    none = F.lit(0).cast("long")
    out = slim_rows.join(found, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("sha", "sha256").alias("kept_sha256"), F.coalesce("n_passages", none).alias("n_passages")
    )
    out = checkpoint(out)
    scratch.drop()
    return out


def remove_repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, digest: bool = False, least_words: int = 0) -> DataFrame:
    """``docs`` without duplicate strings, and n_removed (bytes); with ``digest``, see ``span_digests``.

    A removed span is shortened to whole characters.  With ``least_words`` only
    spans of so many words are removed.  ``docs`` is read twice, so it should be
    a stored table; what is kept of the first time goes by a hash of the text.
    """
    if digest:
        return span_digests(docs, doc_id, text, threshold)
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    key = lambda c: (F.xxhash64(c), F.hash(c))
    table = _numbered(docs, text, scratch, *(k.alias(n) for k, n in zip(key(text), ("k1", "k2"), strict=True)))
    spans = duplicate_positions(table.select("row", "text"), scratch, threshold)
    # Equal texts have equal spans.
    spans = checkpoint(slim(table.select("row", "k1", "k2").join(spans, "row").dropDuplicates(["k1", "k2"]).select("k1", "k2", "spans")))
    scratch.drop()
    names = [c for c in docs.columns if c != "n_removed"]
    own = [f"c{i}" for i in range(len(names))]
    at = names.index(text)
    body = F.col(f"c{at}")
    rows = docs.select(*(F.col(c).alias(o) for c, o in zip(names, own, strict=True)))
    met = rows.join(spans, (key(body)[0] == F.col("k1")) & (key(body)[1] == F.col("k2")), "left").select(*own, "spans")
    result = T.StructType([*rows.schema.fields, T.StructField("removed", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(f"c{at}")
            bounds, pairs = _lists(batch.column("spans"))
            left, removed = texts.to_pylist(), np.zeros(batch.num_rows, np.int64)
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                raw = left[i].encode()
                found = whole_characters(raw, passages(raw, covered_spans(*(x[bounds[i] : bounds[i + 1]] for x in pairs), threshold), least_words))
                kept = without(raw, found)
                left[i], removed[i] = kept.decode(), len(raw) - len(kept)
            columns = [pa.array(left, texts.type) if i == at else batch.column(o) for i, o in enumerate(own)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], result.names)

    out = met.mapInArrow(cut, result)
    return out.select(*(F.col(o).alias(c) for o, c in zip(own, names, strict=True)), F.col("removed").alias("n_removed"))
