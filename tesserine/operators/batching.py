"""Token estimates and greedy requests of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.config import DEFAULTS


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 3)).cast("long")


def requests(rows: DataFrame, keys: list[str], order: str, tokens: str, most: int = DEFAULTS.embed_batch_tokens) -> DataFrame:
    """``keys``, ``order`` and ``batch`` (from 0): rows in order, a new request when the next row would exceed ``most``.

    Rows are dealt by ranges of key and order, so one key of any size uses all
    tasks; only the first key of a task may go on from the task before.  What such
    a task makes of a request that is open as it begins depends on the tokens in it
    alone: they decide which of the task's first rows (as many as ``most`` tokens
    hold) begins the next one.  For each of these rows the task reports how many
    requests follow and what is open at its end; a walk over the reports, task
    after task, gives each task its beginning, and the tasks then number their rows.
    """
    names = [f"k{i}" for i in range(len(keys))]
    slim = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(order).alias("o"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("t"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    # The order is total and the ranges are fixed by the plan, so a task that is run again sees the same rows.
    dealt = slim.repartitionByRange(tasks, *names, "o").sortWithinPartitions(*names, "o", "t").withColumn("task", F.spark_partition_id()).persist()
    begins = _begins(dealt, names, most)
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("batch", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state = None, (0, 0)
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            owners = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True)) if names else [()] * batch.num_rows
            sizes, task = batch.column("t").to_pylist(), batch.column("task")
            for i, (key, size) in enumerate(zip(owners, sizes, strict=True)):
                if owner != key:
                    state = begins.get(task[0].as_py(), (0, 0)) if owner is None else (0, 0)
                    owner = key
                n, total = state
                if total and total + size > most:
                    n, total = n + 1, 0
                state = n, total + size
                out[i] = n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*names, "o"]), pa.array(out)], schema.names)

    return dealt.mapInArrow(number, schema).select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), F.col("o").alias(order), F.col("batch").cast("int").alias("batch"))


def reports(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of the first rows that may begin a request: the tokens up to it, the requests from it on, the tokens open at the end."""
    upto = np.cumsum(sizes)
    before, n = upto - sizes, len(sizes)
    heads = int(np.searchsorted(before, most, "right"))
    # A request has its first row with tokens, whatever its size, and then what fits.
    filled = np.searchsorted(upto, before, "right")
    follow = np.maximum(np.minimum(filled + 1, n), np.searchsorted(upto, before + most, "right")).tolist()
    count, left = [0] * (n + 1), [0] * (n + 1)
    whole, start = int(upto[-1]) if n else 0, before.tolist()
    for i in range(n - 1, -1, -1):
        j = follow[i]
        count[i] = 1 + count[j]
        left[i] = left[j] if j < n else whole - start[i]
    return upto[:heads], np.array(count[:heads], np.int64), np.array(left[:heads], np.int64)


def _begins(dealt: DataFrame, names: list[str], most: int) -> dict[int, tuple[int, int]]:
    """For tasks whose first key goes on: the number of the open request and the tokens in it; a row a task is all that is collected."""
    key_fields = [dealt.schema[n] for n in names]
    fields = [*key_fields, *(T.StructField(n, T.LongType()) for n in ("task", "place", "upto", "count", "left"))]
    schema, columns = T.StructType(fields), [f.name for f in fields]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first key's possible beginnings (place 0 on), that without one (-1), and the last key's end (-2) if it is another."""
        first, last, task, sizes, n, total = None, None, None, [], 0, 0
        for batch in batches:
            owners = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True)) if names else [()] * batch.num_rows
            for key, size, t in zip(owners, batch.column("t").to_pylist(), batch.column("task").to_pylist(), strict=True):
                if first is None:
                    first, task = key, t
                if key == first:
                    sizes.append(size)
                else:
                    if key != last:
                        n, total = 0, 0
                    if total and total + size > most:
                        n, total = n + 1, 0
                    total += size
                last = key
        if first is None:
            return
        upto, count, left = reports(np.array(sizes, np.int64), most)
        rows = [(*first, task, i, *x) for i, x in enumerate(zip(upto.tolist(), count.tolist(), left.tolist(), strict=True))]
        rows.append((*first, task, -1, int(sum(sizes)), 0, 0))
        if last != first:
            rows.append((*last, task, -2, 0, n, total))
        arrays = [pa.array(c) if c_field.dataType != T.StringType() else pa.array(c, pa.string()) for c, c_field in zip(zip(*rows, strict=True), fields, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, columns)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Task after task; rows of a task come by place, so its end and its sum come first."""
        owner, number, total = None, 0, 0
        task, first, end, whole, done = None, None, None, 0, True
        out = []

        def close() -> tuple:
            """What is open after the task: its last key's end, or the first key's if none of its rows began a request."""
            if end is not None:
                return end
            return (first, number, total) if done else (first, number, total + whole)

        for batch in batches:
            owners = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True)) if names else [()] * batch.num_rows
            for key, t, place, upto, count, left in zip(owners, *(batch.column(c).to_pylist() for c in columns[len(names) :]), strict=True):
                if t != task:
                    if task is not None:
                        owner, number, total = close()
                    task, first, end, done = t, None, None, False
                if place == -2:
                    end = (key, count, left)
                elif place == -1:
                    first, whole = key, upto
                    if key != owner:
                        number, total = 0, 0
                    elif owner is not None:
                        out.append((t, number, total))
                elif not done and (total + upto > most if total else upto > 0 or upto == whole):
                    # The row that exceeds what is open; with nothing open, the first rows go into the request at hand.
                    number, total, done = (number + count, left, True) if total else (number + count - 1, left, True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, ["task", "number", "total"])

    ordered = dealt.mapInArrow(report, schema).repartition(1).sortWithinPartitions("task", "place")
    return {r["task"]: (r["number"], r["total"]) for r in ordered.mapInArrow(walk, "task long, number long, total long").collect()}
