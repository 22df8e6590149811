"""Debounce, cooldown and cache look-ups over event streams, in batch form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.config import DEFAULTS


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def debounced(events: DataFrame, user: str, time: str, tie: str, wait_ms: int = DEFAULTS.prefetch_debounce_ms) -> DataFrame:
    """Events after which the same user sends none for ``wait_ms``."""
    order = Window.partitionBy(user).orderBy(micros(F.col(time)), tie)
    gap = F.lead(micros(F.col(time))).over(order) - micros(F.col(time))
    return events.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > wait_ms * 1000)).drop("__gap")


def accepted(events: DataFrame, key: str, time: str, cooldown_s: float = DEFAULTS.prefetch_cooldown_s, folder: str | None = None, ttl_s: float = DEFAULTS.prefetch_ttl_s) -> DataFrame:
    """(key, accepted_us, and ``folder``): the events that are answered anew, greedily in the order of time.

    An event is let go if the last accepted one of its key is less than
    ``cooldown_s`` ago and an answer for its folder, at most ``ttl_s`` old, is
    there.  Each task walks over its keys in order and holds one time a folder
    of one key, so a key of any number of events is a stream, not a list.
    """
    step, live = int(cooldown_s * 1_000_000), int(ttl_s * 1_000_000)
    places = [F.col(folder).alias("folder")] if folder else []
    rows = events.select(F.col(key).alias("key"), micros(F.col(time)).alias("at"), *places).where("at is not null").distinct()
    rows = rows.repartition("key").sortWithinPartitions("key", "at", *(["folder"] if folder else []))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, answered = False, None, {}
        owner = None
        for batch in batches:
            places = batch.column("folder").to_pylist() if folder else [None] * batch.num_rows
            keep = np.zeros(batch.num_rows, bool)
            for i, (k, at, place) in enumerate(zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), places, strict=True)):
                if not known or k != owner:
                    known, owner, last, answered = True, k, None, {}
                if last is not None and at - last < step and place in answered and at - answered[place] <= live:
                    continue
                last = answered[place] = at
                keep[i] = True
            yield batch.filter(pa.array(keep))

    out = rows.mapInArrow(walk, rows.schema).select(F.col("key").alias(key), F.col("at").alias("accepted_us"), *([F.col("folder").alias(folder)] if folder else []))
    return out


def cached(events: DataFrame, key: str, time: str, tie: str, is_set: Column, ttl_s: float = DEFAULTS.prefetch_ttl_s) -> DataFrame:
    """Reads (all events that are no sets) with ``hit``: whether the last set of the key before is at most ``ttl_s`` old."""
    order = Window.partitionBy(key).orderBy(micros(F.col(time)), tie).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(is_set, micros(F.col(time))), ignorenulls=True).over(order)
    age = micros(F.col(time)) - last
    return events.withColumn("hit", F.coalesce(age <= int(ttl_s * 1_000_000), F.lit(False))).where(~is_set)
