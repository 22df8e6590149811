"""Large keys and groups, services that fail or are slow, and logs that stay small."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tesserine.operators import batching, embedding, evals, fusion, providers
from tesserine.operators.logs import LOG_SCHEMA
from tesserine.plans import ingest as plans
from tesserine.streaming.ingest import BoundedLog


def folded(rows, most):
    out, state = {}, {}
    for k, o, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1])):
        n, total = state.get(k, (0, 0))
        if total and total + t > most:
            n, total = n + 1, 0
        state[k] = (n, total + t)
        out[k, o] = n
    return out


@pytest.mark.parametrize(("most", "sizes", "keys"), [(5, [1], "a"), (20, [0, 1, 2], "aaab"), (20, [0, 0, 7, 30], "a"), (100, [1, 5, 9, 200], "aabc"), (3000, [3], "a"), (7, [3, 4], ["a", None, "b"]), (9, [0], "a")])
def test_requests_of_large_keys(spark, most, sizes, keys):
    r = random.Random(most)
    rows = [(r.choice(keys), i, r.choice(sizes)) for i in range(700)]
    made = batching.requests(spark.createDataFrame(rows, "k string, o long, t long").repartition(3), ["k"], "o", "t", most)
    assert {(x["k"], x["o"]): x["batch"] for x in made.collect()} == folded(rows, most)
    # A key of all rows is numbered by all tasks.
    if keys == "a":
        assert made.groupBy(F.spark_partition_id()).count().count() == 4


@pytest.mark.parametrize("sketch", [10_000, 100, 1000])
def test_percentiles_of_any_distribution(spark, monkeypatch, sketch):
    monkeypatch.setattr(evals, "SKETCH", sketch)
    r = random.Random(1)
    values = {"one": [3.0], "two": [1.0, 2.0], "same": [5.0] * 300, "wide": [r.paretovariate(0.3) * r.choice([-1, 1]) for _ in range(4000)], "near": [1 + r.random() * 1e-12 for _ in range(3000)], "few": [float(r.randint(0, 3)) for _ in range(999)], None: [r.random() for _ in range(101)]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("none", None), ("one", None)]
    wanted = [0, 5, 50, 95, 99, 100]
    got = {x["g"]: [x[f"p{p}"] for p in wanted] for x in evals.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", wanted).collect()}
    assert got == {g: [sorted(vs)[round(p / 100 * (len(vs) - 1))] for p in wanted] for g, vs in values.items()}


def limits(**more):
    return providers.Limits(**{"rows": 3, "per_second": 1000.0, "timeout_s": 1.5, "tries": 2, "pause_s": 0.01} | more)


def test_provider_that_fails_or_is_slow(spark, tmp_path):
    log = str(tmp_path / "calls")

    def call(texts):
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        if "slow" in texts:
            time.sleep(60)
        if "bad" in texts:
            raise OSError("no service")
        return [None if t == "odd" else [float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*"abcdefgh", "slow", "bad", "odd", "a", None, ""] * 2)], "i long, t string")
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"))
    began = time.monotonic()
    provider = providers.remote(call, limits=limits(rows=1))
    full = embedding.answered(rows, cache, provider, "t", F.array(F.lit(-1.0)))
    got = [(r["t"], r["vector"]) for r in full.collect()]
    assert full.count() == 28 and time.monotonic() - began < 50
    assert all(v == ([-1.0] if t in ("slow", "bad", "odd") else [float(len(t or ""))]) for t, v in got)
    with open(log) as f:
        calls = sorted(x.rstrip("\n") for x in f)
    # Each text once, the failing one as often as it may be tried; reading twice asks for nothing.
    assert calls == sorted([*"abcdefgh", "slow", "bad", "bad", "odd", ""])
    embedding.answered(rows.where("t in ('a', 'bad')"), cache, providers.remote(call, limits=limits(rows=1)), "t").collect()
    with open(log) as f:
        assert sum(1 for x in f) == len(calls) + 2


def test_calls_are_bounded(monkeypatch):
    now = [0.0]
    bucket = providers.TokenBucket(2.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    at = []
    for _ in range(8):
        bucket.take()
        at.append(now[0])
    assert at[:2] == [0.0, 0.0] and all(abs(a - 0.5 * (k + 1)) < 1e-9 for k, a in enumerate(at[2:]))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"sha": list("abcde"), "text": ["x" * 30, "y" * 30, "z" * 900, "", None]})
    assert [k for k, _ in providers._grouped(iter([batch]), limits(rows=2, tokens=100))] == [["a", "b"], ["c"], ["d", "e"]]


def test_provided_summaries(spark, tmp_path):
    log = str(tmp_path / "calls")

    def call(texts):
        with open(log, "a") as f:
            f.write("".join(t.split("\n")[0] + "\n" for t in texts))
        return [None if "none" in t else f"It does {t.split()[0]}." for t in texts]

    files = spark.createDataFrame([("p/a.txt", "alpha text\n"), ("p/b.txt", "none here\n"), ("p/c.txt", "alpha text\n")], "file string, text string")
    provider = providers.remote(call, "summary_text", "string", limits())
    summaries = plans.provided_summaries(provider, embedding.EmbeddingCache(spark, str(tmp_path / "cache"), "summary_text"))
    store = plans.ChunkStore(spark, str(tmp_path / "store"))
    assert plans.ingest_files(files, store, None, summaries) == (3, 3)
    got = {r["file_path"]: r["summary_text"] for r in store.read().collect()}
    assert got["p/a.txt"].startswith("It does alpha.") and got["p/c.txt"] == got["p/a.txt"] and "likely handles" in got["p/b.txt"]
    with open(log) as f:
        assert sorted(f) == ["alpha text\n", "none here\n"]


def test_rerank_with_a_deadline(spark):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "slow", "fails", "alpha", None])], "query_id long, text string")
    rows = [(k, 10 * k + i, 0.03 - i / 1000 if k != 3 else 0.9 - i / 2, i + 1, s) for k in range(5) for i, s in enumerate(["none", "alpha beta", "alpha", "beta", None])]
    hits = spark.createDataFrame(rows, "query_id long, id long, score double, rank int, code_snippet string")

    def scorer(texts, snippets):
        if texts[0] == "slow":
            time.sleep(20)
        if texts[0] == "fails":
            raise ValueError("no")
        return fusion.overlap_batch(texts, snippets)

    began = time.monotonic()
    got = {}
    for r in fusion.reranked_in_time(hits, q, scorer, budget_ms=1500, most=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"] % 10, r["reranked"]))
    assert time.monotonic() - began < 18
    assert got[0] == [(1, True), (2, True), (0, True), (3, True), (4, True)]
    for k in (1, 2, 3):
        assert got[k] == [(i, False) for i in range(5)]
    assert got[4] == [(i, True) for i in range(5)]
    assert [r["id"] for r in fusion.reranked(hits.where("query_id = 0"), q, 3).orderBy("rank").collect()] == [i for i, _ in got[0]]


def test_logs_stay_bounded(spark, tmp_path):
    log, r = BoundedLog(spark, str(tmp_path / "log")), random.Random(2)
    times = list(range(900))
    r.shuffle(times)
    assert log.read().count() == 0
    for k in range(6):
        name = f"s{k % 2}"
        part = [("ask", float(t), *[None] * 6, 1, 2, float(t)) for t in times[k * 150 : (k + 1) * 150]]
        spark.createDataFrame(part, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{name}")
        # Each start goes on from the checkpoint of the one before.
        log.start(spark.readStream.schema(LOG_SCHEMA).parquet(f"{tmp_path}/in-{name}"), name, f"{tmp_path}/cp-{name}").awaitTermination()
    assert [int(x["ts"]) for x in log.read().collect()] == list(range(700, 900))
    assert len(log._versions("s0")) == 2
    before = [tuple(x) for x in log.read().collect()]
    log.add(spark.createDataFrame(part, LOG_SCHEMA), "s1", 2)
    assert [tuple(x) for x in log.read().collect()] == before
