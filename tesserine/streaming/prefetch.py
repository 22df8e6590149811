"""Structured Streaming twins of the prefetch rules.

Events may come in any order within the allowed lateness.  Where the order counts
(cooldown, cache), a key's events wait in its state until the watermark has passed
them, and are then taken in the order of time, so the results are those of the
batch form whatever micro-batches they came in.  State goes by event time: a timer
wakes the key when its next event may be taken, and when the last answer has
expired.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tesserine.config import DEFAULTS
from tesserine.operators.prefetch import micros

LATE = "10 minutes"


def debounced(events: DataFrame, user: str, time: str, wait_ms: int = DEFAULTS.prefetch_debounce_ms, late: str = "10 seconds") -> DataFrame:
    """(user, fired_at): the last event of each session of a user; a session ends after ``wait_ms`` without one."""
    sessions = events.withWatermark(time, late).groupBy(user, F.session_window(time, f"{wait_ms} milliseconds"))
    return sessions.agg(F.max(time).alias("fired_at")).select(user, "fired_at")


class InOrder(StatefulProcessor):
    """Hands a key's events to ``take`` in order, once the watermark has passed them.

    ``fields`` are the columns of a waiting event after ``at`` (microseconds); what
    ``take`` gives becomes rows of ``columns``.
    """

    fields: str
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at bigint, {self.fields}")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, events: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def expires(self) -> int | None:
        """When, in microseconds, all else in the state means nothing any more; None if there is nothing."""
        raise NotImplementedError

    def expire(self, now: int) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(x.item() if hasattr(x, "item") else x for x in row) for frame in rows for row in frame.drop(columns=["key", "time"]).itertuples(index=False, name=None)]
        new = [tuple(None if isinstance(x, float) and x != x else x for x in row) for row in new]
        self.waiting.appendList(new)
        self._wake(min(row[0] for row in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = list(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [e for e in events if e[0] <= now], [e for e in events if e[0] > now]
        self.waiting.put(rest) if rest else self.waiting.clear()
        found = self.take(sorted(ready, key=lambda e: tuple((x is not None, x) for x in e))) if ready else []
        self.expire(now)
        wake = [t for t in (rest and min(e[0] for e in rest), self.expires()) if t]
        if wake:
            self._wake(min(wake))
        if found:
            yield pd.DataFrame([(key[0], *row) for row in found], columns=["key", *self.columns])

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def close(self) -> None:
        pass


class Cooldown(InOrder):
    """Accepted events of a key; the state has the last one's time and, by folder, that of the last answer."""

    fields, columns = "folder string", ["folder", "at"]

    def __init__(self, step: int, live: int):
        self.step, self.live = step, live

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last, self.answered = handle.getValueState("last", "at bigint"), handle.getMapState("answered", "folder string", "at bigint")

    def take(self, events: list[tuple]) -> list[tuple]:
        last = self.last.get()[0] if self.last.exists() else None
        found, before = [], None
        for event in events:
            if event == before:
                continue
            before = event
            at, folder = event
            place = ("" if folder is None else f"/{folder}",)
            if last is not None and at - last < self.step and self._answer_lives(place, at):
                continue
            last = at
            self.answered.updateValue(place, (at,))
            found.append((folder, at))
        self.last.update((last,))
        return found

    def _answer_lives(self, place: tuple[str], at: int) -> bool:
        return self.answered.containsKey(place) and at - self.answered.getValue(place)[0] <= self.live

    def expires(self) -> int | None:
        return self.last.get()[0] + max(self.step, self.live) if self.last.exists() else None

    def expire(self, now: int) -> None:
        """An answer that is too old counts no more, nor does a time further back than the cooldown."""
        for place, (at,) in list(self.answered.iterator()) if self.answered.exists() else []:
            if at + self.live < now:
                self.answered.removeKey(place)
        if (end := self.expires()) is not None and end < now:
            self.last.clear()
            self.answered.clear()


class Cache(InOrder):
    """Whether each read of a key finds a set that is young enough; the state has the last set's time."""

    columns = ["tie", "hit"]

    def __init__(self, live: int, tie: str):
        self.live, self.fields = live, f"tie {tie}, is_set boolean"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.set = handle.getValueState("set", "at bigint")

    def take(self, events: list[tuple]) -> list[tuple]:
        last = self.set.get()[0] if self.set.exists() else None
        found = []
        for at, tie, is_set in events:
            if is_set:
                last = at
            else:
                found.append((tie, last is not None and at - last <= self.live))
        if last is not None:
            self.set.update((last,))
        return found

    def expires(self) -> int | None:
        return self.set.get()[0] + self.live if self.set.exists() else None

    def expire(self, now: int) -> None:
        if (end := self.expires()) is not None and end < now:
            self.set.clear()


def _with_state(spark: SparkSession) -> None:
    """State of several variables and timers needs this store; it is used by queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(events: DataFrame, key: str, time: str, late: str, columns: list[Column], processor: InOrder, result: str) -> DataFrame:
    _with_state(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.select(F.col(key).alias("key"), micros(F.col(time)).alias("at"), *columns, F.col(time).alias("time"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"key {kind}, {result}", outputMode="append", timeMode="eventTime")


def accepted(events: DataFrame, key: str, time: str, cooldown_s: float = DEFAULTS.prefetch_cooldown_s, late: str = LATE, folder: str | None = None, ttl_s: float = DEFAULTS.prefetch_ttl_s) -> DataFrame:
    """(key, accepted_at, and ``folder``): the events that are answered anew, as ``operators.prefetch.accepted`` has them."""
    place = F.col(folder).cast("string") if folder else F.lit(None).cast("string")
    out = _in_order(events, key, time, late, [place.alias("folder")], Cooldown(int(cooldown_s * 1_000_000), int(ttl_s * 1_000_000)), "folder string, at long")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias("accepted_at"), *([F.col("folder").alias(folder)] if folder else []))


def cached(events: DataFrame, key: str, time: str, tie: str, is_set: Column, ttl_s: float = DEFAULTS.prefetch_ttl_s, late: str = LATE) -> DataFrame:
    """(key, ``tie``, hit) of each read, as ``operators.prefetch.cached`` has them; ``tie`` orders events of one time and names them."""
    kind = events.schema[tie].dataType.simpleString()
    out = _in_order(events, key, time, late, [F.col(tie).alias("tie"), is_set.alias("is_set")], Cache(int(ttl_s * 1_000_000), kind), f"tie {kind}, hit boolean")
    return out.select(F.col("key").alias(key), F.col("tie").alias(tie), "hit")
