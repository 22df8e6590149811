"""Providers that call a service: in small batches, side by side, at a bounded rate, with time-outs.

A provider maps (sha, text) to (sha, answer).  Rows are streamed through each task:
texts are put together to calls of bounded rows and tokens, a few calls are under
way at a time, and a token bucket holds each task to its share of the rate.  A call
that fails is tried again after a pause; one that fails for good, or is late, gives
null answers, in whose place the caller puts a default one.  No call is waited for
longer than its time-out.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserine.config import DEFAULTS
from tesserine.operators.embedding import Provider

Call = Callable[[list[str]], list]


@dataclass(frozen=True)
class Limits:
    rows: int = 16
    tokens: int = DEFAULTS.embed_batch_tokens
    #: Calls a second of all tasks together, and calls under way in one task.
    per_second: float = 2.0
    side_by_side: int = 4
    timeout_s: float = 30.0
    tries: int = 3
    pause_s: float = 0.5


class TokenBucket:
    """Lets ``rate`` calls a second through, and as many as a second's at once after a rest."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.most = max(1.0, rate)
        self.held, self.at = self.most, clock()

    def take(self) -> None:
        now = self.clock()
        self.held = min(self.most, self.held + (now - self.at) * self.rate)
        self.at = now
        self.held -= 1
        if self.held < 0:
            self.sleep(-self.held / self.rate)


def _tried(call: Call, texts: list[str], limits: Limits, end: float) -> list:
    for n in range(limits.tries):
        try:
            found = call(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} answers to {len(texts)} texts")
            return found
        except Exception:  # noqa: BLE001 - whatever a service raises
            rest = limits.pause_s * 2**n
            if n + 1 == limits.tries or time.monotonic() + rest > end:
                break
            time.sleep(rest)
    return [None] * len(texts)


def _grouped(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[tuple[list[str], list[str]]]:
    """(digests, texts) of calls; a text of more tokens than a call may have goes alone."""
    keys, texts, total = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("sha").to_pylist(), batch.column("text").to_pylist(), strict=True):
            size = max(1, len(text or "") // 3)
            if texts and (len(texts) == limits.rows or total + size > limits.tokens):
                yield keys, texts
                keys, texts, total = [], [], 0
            keys.append(key)
            texts.append(text or "")
            total += size
    if texts:
        yield keys, texts


def remote(call: Call, column: str = "vector", kind: str = "array<double>", limits: Limits = Limits()) -> Provider:
    """The provider of ``call`` (texts to answers, None for none), of which rows give (sha, ``column``)."""
    types = {"array<double>": pa.list_(pa.float64()), "string": pa.string()}

    def provider(rows: DataFrame) -> DataFrame:
        slots = rows.sparkSession.sparkContext.defaultParallelism

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, pool = TokenBucket(limits.per_second / slots), ThreadPoolExecutor(limits.side_by_side)
            waiting: deque[tuple[list[str], Future, float]] = deque()

            def first() -> pa.RecordBatch:
                nonlocal pool
                keys, future, end = waiting.popleft()
                try:
                    found = future.result(max(0.0, end - time.monotonic()))
                except TimeoutError:
                    found = [None] * len(keys)
                    if not future.cancel():
                        # It keeps its thread until it returns; the calls that follow get threads of their own.
                        pool.shutdown(wait=False)
                        pool = ThreadPoolExecutor(limits.side_by_side)
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, types[kind])], ["sha", column])

            for keys, texts in _grouped(batches, limits):
                if len(waiting) == limits.side_by_side:
                    yield first()
                bucket.take()
                end = time.monotonic() + limits.timeout_s
                waiting.append((keys, pool.submit(_tried, call, texts, limits, end), end))
            while waiting:
                yield first()
            pool.shutdown(wait=False)

        # One shuffle deals the texts over all slots; a text of a slow call holds up its own task only.
        return rows.select("sha", "text").repartition(slots).mapInArrow(run, f"sha string, {column} {kind}")

    return provider
