"""Streams give what the batch forms give, whatever micro-batches events come in."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tesserine.operators import prefetch
from tesserine.streaming import prefetch as streams

SCHEMA = "event_id long, user_id long, ts timestamp, kind string"


def shuffled_events(spark, path, seed, late_s=500):
    """Events of 3,000 seconds in five files; each is late by less than ``late_s``. A last one, far ahead, lets all of them pass."""
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(i, r.choice([1, 2, 3]), start + timedelta(seconds=r.randint(0, 3000), microseconds=r.choice([0, 1])), r.choice(["a", "b", None])) for i in range(300)]
    rows += [(300 + i, *rows[i][1:]) for i in range(20)]
    rows.sort(key=lambda x: (x[2] - start).total_seconds() + r.uniform(0, late_s))
    parts = [rows[k * 64 : (k + 1) * 64] for k in range(5)] + [[(999, 99, start + timedelta(days=9), "a")]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.createDataFrame(rows, SCHEMA), parts


def run(spark, path, parts, stream, name):
    """All parts, a micro-batch each."""
    out = str(path / f"out-{name}")
    rows = None
    for k in range(len(parts)):
        spark.read.schema(SCHEMA).parquet(f"{path}/in/{k}").coalesce(1).write.mode("append").parquet(f"{path}/arrive-{name}")
        source = spark.readStream.schema(SCHEMA).parquet(f"{path}/arrive-{name}")
        rows = stream(source)
        rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/cp-{name}").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def test_cooldown_by_folder(spark, tmp_path):
    events, parts = shuffled_events(spark, tmp_path / "in", 1)
    wanted = prefetch.accepted(events, "user_id", "ts", 60, "kind", 200).select("user_id", "accepted_us", "kind")
    got = run(spark, tmp_path, parts, lambda s: streams.accepted(s, "user_id", "ts", 60, "600 seconds", "kind", 200), "folders")
    got = got.where("user_id <> 99").select("user_id", F.unix_micros("accepted_at").alias("accepted_us"), "kind")
    rows = lambda f: sorted((tuple(x) for x in f.collect()), key=str)
    assert rows(got) == rows(wanted) and got.count() > 30


def test_cache_look_ups(spark, tmp_path):
    events, parts = shuffled_events(spark, tmp_path / "in", 2)
    is_set = F.coalesce(F.col("kind") == "a", F.lit(False))
    wanted = prefetch.cached(events, "user_id", "ts", "event_id", is_set, 40).select("event_id", "hit")
    got = run(spark, tmp_path, parts, lambda s: streams.cached(s, "user_id", "ts", "event_id", is_set, 40, "600 seconds"), "cache").where("user_id <> 99").select("event_id", "hit")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert 0 < got.where("hit").count() < got.count()
