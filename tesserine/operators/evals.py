"""Retrieval metrics, latency statistics and answer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.operators.files import rows_of
from tesserine.operators.needles import fits, holding

#: Ranks in a sketch of a group are right to one in so many.
SKETCH = 10_000


def query_metrics(run: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """recall, hit and rr of every query of ``expected`` (query_id, path); ``run`` has query_id, path and rank.

    A path that is ranked twice counts once for recall; the reciprocal rank
    is that of the first match in the whole list.
    """
    wanted = expected.distinct()
    total = wanted.groupBy("query_id").agg(F.count("path").alias("n"))
    met = run.join(wanted, ["query_id", "path"]).groupBy("query_id").agg(F.countDistinct(F.when(F.col("rank") <= k, F.col("path"))).alias("found"), F.min("rank").alias("first"))
    return total.join(met, "query_id", "left").select(
        "query_id",
        F.when(F.col("n") > 0, F.coalesce("found", F.lit(0)) / F.col("n")).otherwise(0.0).alias("recall"),
        (F.coalesce("found", F.lit(0)) > 0).cast("int").alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def holders(docs: DataFrame, passages: DataFrame, words: int = 5) -> DataFrame:
    """(query_id, path): the documents (path, text) that hold a passage (query_id, passage) whole.

    Passages are looked for all at once where a document is read (``needles``), as
    long as they fit one automaton.  Of more of them, the words of a passage but its
    first and last stand in the document as they are, so the two are joined on the
    first run of ``words`` of them; what meets is then looked at.  Those that are too
    short for a run are looked for in every document.
    """
    known = passages.where("passage is not null").select("query_id", "passage")

    def held(some: DataFrame) -> DataFrame:
        met = holding(docs.select("path", "text"), "text", some.select(F.col("passage").alias("__passage")), "__passage").select("path", "__passage")
        return met.join(some, F.col("__passage") == F.col("passage")).select("query_id", "path")

    if fits(known, "passage"):
        return held(known).distinct()

    def runs(text: Column) -> Column:
        def joined(h: Column) -> Column:
            inner = F.when(F.size(h) >= words, F.sequence(F.lit(0), F.size(h) - words))
            return F.coalesce(F.transform(inner, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words)))), F.array().cast("array<bigint>"))

        # As a lambda's variable the hashes are made once a text, not once an element.
        hashes = F.transform(F.split(text, r"\s+"), lambda w: F.xxhash64(w))
        return F.element_at(F.transform(F.array(hashes), joined), 1)

    asked = known.withColumn("__n", F.size(F.split("passage", r"\s+")))
    long = asked.where(F.col("__n") >= words + 2).select("query_id", "passage", F.get(runs(F.col("passage")), F.lit(1)).alias("__run"))
    short = asked.where(F.col("__n") < words + 2).select("query_id", "passage")
    # Only numbers are exploded; texts meet what is left of the pairs.
    places = docs.select("path", F.explode(F.array_distinct(runs(F.col("text")))).alias("__run"))
    pairs = places.join(long, "__run").select("path", "query_id", "passage").distinct().persist()
    met = rows_of(pairs, docs, "path").join(pairs, "path").where(F.contains("text", "passage")).select("query_id", "path")
    return met.unionByName(held(short)).distinct()


def averaged(metrics: DataFrame) -> DataFrame:
    """One row of macro averages, to four places."""
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return metrics.agg(F.count(F.lit(1)).alias("queries_scored"), mean("hit").alias("hit_rate_at_k"), mean("recall").alias("recall_at_k"), mean("rr").alias("mrr"))


def percentiles(values: DataFrame, group: str, value: str, wanted: list[float]) -> DataFrame:
    """Nearest-rank percentiles (rank p/100 * (n - 1), halves to even) a group: p<wanted> columns.

    A sketch of each group gives, for each percentile, a range of values that holds
    it for certain (its ranks are right to one in ``SKETCH``; the range takes eight
    on both sides, and all of a group of at most so many rows).  A second pass counts what is below the range and the equal
    values in it, in each task first; only the latter, a few in ``SKETCH`` of a
    group, are put in order.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    shares = [p / 100.0 for p in wanted]
    margin = 8.0 / SKETCH
    edges = [F.lit(max(0.0, q - margin)) for q in shares] + [F.lit(min(1.0, q + margin)) for q in shares]
    sketch = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", F.array(*edges), SKETCH).alias("edge"))
    ranges = [
        F.struct(
            F.lit(i).alias("i"), F.bround(F.lit(q) * (F.col("n") - 1), 0).alias("at"), F.when((F.col("n") > SKETCH) & F.lit(q > margin), F.col("edge")[i]).alias("low"), F.when((F.col("n") > SKETCH) & F.lit(q < 1 - margin), F.col("edge")[i + len(shares)]).alias("high")
        )
        for i, q in enumerate(shares)
    ]
    wide = sketch.select(F.col("g").alias("h"), F.explode(F.array(*ranges)).alias("r")).select("h", "r.*")
    # Below the range, in it, above it.
    place = F.when(F.col("v") < F.col("low"), 0).when(F.col("v") > F.col("high"), 2).otherwise(1)
    near = rows.join(wide, F.col("g").eqNullSafe(F.col("h"))).withColumn("place", place)
    counted = near.groupBy("g", "i", "place", F.when(F.col("place") == 1, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"), F.first("at").alias("at"))
    upto = F.sum("c").over(Window.partitionBy("g", "i").orderBy("place", "v"))
    found = counted.withColumn("upto", upto).where(F.col("upto") > F.col("at")).groupBy("g", "i").agg(F.min_by("v", "upto").alias("v"))
    # Were a sketch worse than it says, the value would be missing: better no result than a wrong one.
    sure = F.when(F.col("v").isNotNull(), F.col("v")).otherwise(F.raise_error(F.lit("a percentile is outside of the range of its sketch")))
    each = found.withColumn("v", sure).groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"p{p:g}") for i, p in enumerate(wanted)))
    return each.withColumnRenamed("g", group)


def latency_summary(values: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, p95, p99 and population deviation a group, to one place."""
    rounded = lambda c: F.bround(c, 1)
    basic = values.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(value)).alias("mean"), rounded(F.coalesce(F.stddev_pop(value), F.lit(0.0))).alias("stdev"))
    return basic.join(percentiles(values, group, value, [95, 99]).select(group, rounded(F.col("p95")).alias("p95"), rounded(F.col("p99")).alias("p99")), group)


def answer_ok(answer: Column, must: Column, must_not: Column) -> Column:
    """Whether an answer has all of one list of phrases and none of another, in any case."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    used = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda s: F.trim(s) != "")
    return F.forall(used(must), lambda s: F.contains(low, F.lower(s))) & ~F.exists(used(must_not), lambda s: F.contains(low, F.lower(s)))


def pass_rate(rows: DataFrame, group: str, ok: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("queries_scored"), F.bround(F.avg(ok.cast("int")), 4).alias("pass_rate"))
