"""Product codes of vectors: integer k-means on parts, with bounds that are kept between rounds.

A vector is cut into equal consecutive parts; each part's place has a codebook of
integer entries, which starts as that part of the first vectors by id.  A round
assigns every part to its nearest entry (squared distance, ties to the lower
index) and moves each entry to the rounded-down mean of its parts.

Each part keeps, from round to round, its entry, an upper bound of the distance to
it and a lower bound of the distance to the second nearest.  When entries move,
the upper bound grows by the way of the own entry and the lower one shrinks by
the longest way of any other.  Where the upper bound is strictly below the lower
one the entry is still the only nearest and nothing is computed; else the upper
bound is made exact, and if it is still not strictly below, all entries are
measured anew, so ties go to the lower index.  Bounds are rounded outwards, and
distances are integers held exactly in doubles (or in Python integers where
components are too large for that), so codes equal those of full searches.

Spark holds the vectors, codes and bounds in a table that each round reads and
writes anew in the checkpoint folder; the codebooks (``parts * entries`` rows,
whatever the input) and their sums are all that the driver sees.

Defined results: rows whose vector is null, or has null or non-finite components,
are left out; vectors of unequal lengths, or of a length that is no multiple of
the number of parts, raise, as do components so large that a squared distance
may not fit a long (2**27 units or 131,072 at 64 components and this scale).  Rows that
repeat an id are coded each (of equal ids the lesser vector starts a codebook); a
null id comes last.  An empty table gives no rows.  Fewer vectors than entries
give a smaller codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.llm.common import Scratch, bound_batches, checkpoint

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a batch that are measured against all entries at a time.
STEP = 4096
#: The state of a vector beside its columns.
UNITS, CODE, UPPER, LOWER, ERROR = "units", "code", "upper", "lower", "error"


@dataclass
class Codebooks:
    """Entries as integers (parts, entries, size of a part), and how far each moved last (rounded up)."""

    entries: np.ndarray
    way: np.ndarray

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Each entry at the rounded-down mean of its parts; one without parts stays."""
        after = self.entries.copy()
        for (part, entry), (n, total) in sums.items():
            after[part, entry] = [x // n for x in total]
        far = ((after.astype(object) - self.entries.astype(object)) ** 2).sum(axis=2) if after.size else np.zeros(after.shape[:2])
        return Codebooks(after, _up(np.sqrt(far.astype(np.float64))))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _up(x: np.ndarray) -> np.ndarray:
    """A little more: doubles of which roots and sums are rounded to nearest are at most one step below the truth."""
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def distances(units: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to entries."""
    most = max(int(np.abs(units).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, units.shape[1]) < 1 << 53:
        u, e = units.astype(np.float64), entries.astype(np.float64)
        return (u * u).sum(axis=1)[:, None] - 2 * (u @ e.T) + (e * e).sum(axis=1)[None, :]
    u, e = units.astype(object), entries.astype(object)
    return np.array([((e - row) ** 2).sum(axis=1) for row in u], dtype=object).reshape(len(u), len(e))


def own_distances(units: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to the entry of each."""
    most = max(int(np.abs(units).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, units.shape[1]) < 1 << 53 else object
    return ((units.astype(kind) - entries[code].astype(kind)) ** 2).sum(axis=1)


def search(units: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the nearest entry (the lowest of equals), an upper bound of its distance and a lower one of the second's."""
    code, upper, lower = np.empty(len(units), np.int64), np.empty(len(units)), np.empty(len(units))
    for k in range(0, len(units), STEP):
        far = distances(units[k : k + STEP], entries)
        rows = np.arange(len(far))
        best = np.argmin(far, axis=1)
        nearest = far[rows, best].astype(np.float64)
        far[rows, best] = np.inf
        second = far.min(axis=1).astype(np.float64)
        code[k : k + STEP], upper[k : k + STEP], lower[k : k + STEP] = best, _up(np.sqrt(nearest)), _down(np.sqrt(second))
    return code, upper, lower


def reassign(units: np.ndarray, entries: np.ndarray, way: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Bring one part's codes and bounds up to date after a move, in place; how many rows were searched in full."""
    far = np.sort(way)[::-1]
    rest = np.where(way[code] == far[0], far[1] if len(far) > 1 else 0.0, far[0])
    upper[:], lower[:] = _up(upper + way[code]), _down(lower - rest)
    loose = np.flatnonzero(~(upper < lower))
    if len(loose):
        upper[loose] = _up(np.sqrt(own_distances(units[loose], entries, code[loose]).astype(np.float64)))
        loose = loose[~(upper[loose] < lower[loose])]
    if len(loose):
        code[loose], upper[loose], lower[loose] = search(units[loose], entries)
    return len(loose)


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(rows.ravel(), kind))


def _assigned(state: DataFrame, kept: list[T.StructField], books: Codebooks, first: bool) -> DataFrame:
    """The state with codes, bounds and exact errors by the present codebooks."""
    parts, _, width = books.entries.shape
    schema = T.StructType(
        [*kept, T.StructField(UNITS, T.ArrayType(T.LongType())), T.StructField(CODE, T.ArrayType(T.LongType())), T.StructField(UPPER, T.ArrayType(T.DoubleType())), T.StructField(LOWER, T.ArrayType(T.DoubleType()))]
    )
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            units = _matrix(batch.column(UNITS), np.int64, parts * width)
            code, upper, lower = (np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))) if first else (_matrix(batch.column(c), k, parts).copy() for c, k in ((CODE, np.int64), (UPPER, np.float64), (LOWER, np.float64)))
            for p in range(parts):
                own = units[:, p * width : (p + 1) * width]
                if first:
                    code[:, p], upper[:, p], lower[:, p] = search(own, books.entries[p])
                else:
                    reassign(own, books.entries[p], books.way[p], code[:, p], upper[:, p], lower[:, p])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), batch.column(UNITS), _lists(code, pa.int64()), _lists(upper, pa.float64()), _lists(lower, pa.float64())], names)

    return state.mapInArrow(run, schema)


def _sums(state: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Number and component sums of the parts of each entry: added up in each task, then by Spark; a row an entry."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            units, code = _matrix(batch.column(UNITS), np.int64, parts * width), _matrix(batch.column(CODE), np.int64, parts)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p], code[:, p], units[:, p * width : (p + 1) * width])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), _lists(total[p, e], pa.int64())], ["part", "entry", "n", "total"])

    found = state.select(UNITS, CODE).mapInArrow(run, "part long, entry long, n long, total array<long>")
    each = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    return {(r["part"], r["entry"]): (r["n"], [int(r[f"s{k}"]) for k in range(width)]) for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()}


def vector_codes(
    rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """(``vec_id``, ``label``, ``codes`` (an entry a part), ``error``: the squared distances), and the final codebooks."""
    spark = rows.sparkSession
    bound_batches(spark)
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    units = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    id_, label_ = "__id", "__label"
    whole = rows.where(v.isNotNull() & finite).select(F.col(vec_id).alias(id_), F.col(label).alias(label_), units.alias(UNITS))
    scratch = Scratch(spark)
    state = scratch.table(whole)
    shape = state.agg(F.min(F.size(UNITS)).alias("least"), F.max(F.size(UNITS)).alias("most"), F.max(F.array_max(F.transform(UNITS, F.abs))).alias("far")).first()
    length, far = shape["most"] or 0, shape["far"] or 0
    if shape["least"] != shape["most"] or length % parts or 4 * length * far * far >= 1 << 63:
        raise ValueError(f"vectors need one length, a multiple of {parts}, and distances that fit a long; got lengths {shape['least']} to {shape['most']}, components up to {far} units")
    width = length // parts
    head = state.orderBy(F.col(id_).asc_nulls_last(), UNITS).limit(entries).select(UNITS).collect()
    start = np.array([r[0] for r in head], np.int64).reshape(len(head), parts, width).transpose(1, 0, 2)
    books = Codebooks(start, np.zeros(start.shape[:2]))
    kept = [f for f in state.schema.fields if f.name != UNITS]
    for k in range(rounds + 1 if head else 0):
        after = scratch.table(_assigned(state, kept, books, k == 0))
        scratch.remove(state)
        state = after
        if k < rounds:
            books = books.moved(_sums(state, books))
    results = checkpoint(_results(state, kept, books, vec_id, label))
    scratch.drop()
    return results, books


def _results(state: DataFrame, kept: list[T.StructField], books: Codebooks, vec_id: str, label: str) -> DataFrame:
    parts, _, width = books.entries.shape
    schema = T.StructType([T.StructField(vec_id, kept[0].dataType), T.StructField(label, kept[1].dataType), T.StructField("codes", T.ArrayType(T.LongType())), T.StructField(ERROR, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, code = _matrix(batch.column(UNITS), np.int64, parts * width), _matrix(batch.column(CODE), np.int64, parts)
            far = np.zeros(len(batch), object)
            for p in range(parts):
                far = far + own_distances(units[:, p * width : (p + 1) * width], books.entries[p], code[:, p])
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [_lists(code, pa.int64()), pa.array([int(x) for x in far], pa.int64())], [f.name for f in schema.fields])

    if CODE not in state.columns:
        return state.sparkSession.createDataFrame([], schema)
    return state.select(*(f.name for f in kept), UNITS, CODE).mapInArrow(run, schema)
