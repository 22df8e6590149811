"""Near-duplicate detection with BagMinHash over multisets of word shingles.

A text is the multiset of its five-word shingles.  For every shingle a
hierarchy of Poisson processes runs over the discretised weight axis: [0, 1)
with rate 1, [1, 2) with rate 1, [2, 4) with rate 2, and so on.  A point of
process j belongs to the text if the weight of the shingle exceeds the level
at which the point lies; it falls into one of ``SLOTS`` slots, and the
earliest point of each slot is the signature.  Two signatures agree in a slot
with the probability of the weighted Jaccard similarity, without bias.  Points
come in ascending order, so a process stops as soon as it is behind the
latest slot of its text.

Texts with the same multiset are one class from the start, so a group of
copies is one row in all that follows.  Signatures are banded (``BANDS`` bands
of ``ROWS``: a pair at the threshold is missed with probability 3e-6).
In a bucket every member is compared with the least and the greatest one, not
with all others.  What this could miss is a link between two members that are
in different components after it; buckets that still hold several components
are therefore compared exhaustively, in blocks of bounded size, so no link
that the bands show is lost.  Every link is verified by the exact overlap of
the multisets.

Defined results: a text without words (null included) is a class of its own;
one of less than five words has one shingle of all its words; repeated rows
are copies.  A class is named by its smallest doc_id; that row (null last)
stays.  Further columns are not read; ``drop_near_duplicates`` keeps them,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.blocks import Hasher, mix, ragged, text_blocks
from tesserine.llm.common import Scratch, bound_batches, checkpoint, keep_rows, slim, text_key
from tesserine.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 42, 6
SLOTS = BANDS * ROWS
#: Pairs whose signatures agree in less than this share of slots are not verified: six deviations below the threshold.
LEAST_ESTIMATE = 0.65
#: Rows of a block of a bucket that is compared exhaustively.
BLOCK_ROWS = 400

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_hashers: list[Hasher] = []


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all shingles of a block, sorted by text and hash."""
    if not _hashers:
        _hashers.append(Hasher(21))
    hasher = _hashers[0]
    n_texts = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    visible = ~_SPACE[data]
    cut = np.empty(len(data), bool)
    cut[0] = True
    np.not_equal(visible[1:], visible[:-1], out=cut[1:])
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.append(np.flatnonzero(cut), len(data))
    word = visible[at[:-1]]
    start, end = at[:-1][word], at[1:][word]
    h = hasher.spans(hasher.table[data], start, end)
    first = np.searchsorted(start, offsets)
    n_words = np.diff(first)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    joined, power = np.zeros(len(h), np.uint64), 1
    shorter = np.repeat(np.minimum(n_words, size), n_words)
    for k in range(size):
        part = padded[k : k + len(h)] * np.uint64(power)
        joined += np.where(k < shorter, part, np.uint64(0))
        power = power * int(_STEP) % (1 << 64)
    joined = mix(joined + shorter.astype(np.uint64) * _GOLD)
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    text = np.repeat(np.arange(n_texts), count)
    h = joined[ragged(first[:-1], count)]
    order = np.lexsort((h, text))
    return h[order], text[order]


def occurrences(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a new element begins, and the occurrence number of each shingle."""
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.empty(0, np.int64)
    weight = np.diff(np.append(new, len(h)))
    return new, np.arange(len(h)) - np.repeat(new, weight)


def signatures(element: np.ndarray, weight: np.ndarray, text: np.ndarray, n_texts: int, slots: int = SLOTS) -> np.ndarray:
    """Ids of the earliest point in each slot of each text; element, weight and text describe the multisets."""
    time = np.full(n_texts * slots, np.inf)
    ids = np.zeros(n_texts * slots, np.uint64)
    latest = np.full(n_texts, np.inf)
    # Process j covers the levels [low, low + rate).
    parts, j, low, rate = [], 0, 0, 1
    while True:
        reach = np.flatnonzero(weight > low)
        if not len(reach):
            break
        parts.append((mix(element[reach] + np.uint64((j + 1) * int(_GOLD) % (1 << 64))), text[reach], np.full(len(reach), float(rate)), (weight[reach] - low) / rate))
        low, rate, j = low + rate, low + rate, j + 1
    if not parts:
        return ids.reshape(n_texts, slots)
    seed, owner, rate_of, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    clock, step, points = np.zeros(len(seed)), 0, 1
    while len(seed):
        draw = mix(seed[:, None] + np.arange(step + 1, step + points + 1, dtype=np.uint64) * _STEP)
        wait = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate_of[:, None]
        at = clock[:, None] + np.cumsum(wait, axis=1)
        other = mix(draw ^ _GOLD)
        inside = (other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < share[:, None]
        good = inside & (at < latest[owner][:, None])
        slot = ((other >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        place = (owner[:, None] * slots + slot)[good]
        times, names = at[good], other[good]
        np.minimum.at(time, place, times)
        won = time[place] == times
        ids[place[won]] = names[won]
        latest = time.reshape(n_texts, slots).max(axis=1)
        clock, step = at[:, -1], step + points
        left = np.flatnonzero(clock < latest[owner])
        seed, owner, rate_of, share, clock = seed[left], owner[left], rate_of[left], share[left], clock[left]
        points = max(1, min(2 * points, 64, 100_000 // max(1, len(seed)))) if step > 1 else 1
    return ids.reshape(n_texts, slots)


def band_keys(ids: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    parts = ids.reshape(len(ids), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, (len(ids), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * _STEP + parts[:, :, k])
    return key


FEATURES = "row long, doc_id {id}, text_key long, n long, bag long, bag2 long, bands array<long>, signature binary"


def features(rows: DataFrame) -> DataFrame:
    """Multiset hashes, band keys and a byte a slot of each text of ``rows`` (row, doc_id, text_key, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text")):
                n = j - i
                h, text = shingles(data, offsets)
                new, nth = occurrences(h, text)
                each = mix(h + nth.astype(np.uint64) * _GOLD)
                first = np.searchsorted(text, np.arange(n + 1))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
                total2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(each ^ _STEP))])
                ids = signatures(h[new], np.diff(np.append(new, len(h))), text[new], n)
                keys = band_keys(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(i, n),
                        batch.column("doc_id").slice(i, n),
                        batch.column("text_key").slice(i, n),
                        pa.array(np.diff(first)),
                        pa.array((total[first[1:]] - total[first[:-1]]).view(np.int64)),
                        pa.array((total2[first[1:]] - total2[first[:-1]]).view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, keys.ravel().view(np.int64)),
                        pa.array([x.tobytes() for x in (ids & np.uint64(255)).astype(np.uint8)], pa.binary()),
                    ],
                    ["row", "doc_id", "text_key", "n", "bag", "bag2", "bands", "signature"],
                )

    return rows.mapInArrow(scan, FEATURES.format(id=rows.schema["doc_id"].dataType.simpleString()))


def multisets(rows: DataFrame) -> DataFrame:
    """(doc_id, bag, bag2, elements): sorted hashes of (shingle, occurrence) as bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text")):
                h, text = shingles(data, offsets)
                _, nth = occurrences(h, text)
                each = mix(h + nth.astype(np.uint64) * _GOLD)
                first = np.searchsorted(text, np.arange(j - i + 1))
                parts = [each[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                bags = [np.array([f(x).sum(dtype=np.uint64) for x in parts], np.uint64).view(np.int64) for f in (lambda x: x, lambda x: mix(x ^ _STEP))]
                own = [pa.array([np.sort(x).tobytes() for x in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *map(pa.array, bags), *own], ["doc_id", "bag", "bag2", "elements"])

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bag long, bag2 long, elements binary")


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two multisets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0.0
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return common / (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets reach the threshold; ``sets`` has node and elements."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            good = [overlap(xs[i].as_py(), ys[i].as_py()) >= threshold for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(scan, "a long, b long")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose signatures come near it."""
    side = lambda n: nodes.select(F.col("node").alias(n), F.col("n").alias(f"n{n}"), F.col("signature").alias(f"s{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("sa", "sb"))
            good = (a == b).mean(axis=1) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "sa", "sb").mapInArrow(scan, "a long, b long")


def star_pairs(bands: DataFrame) -> DataFrame:
    """Each member of a bucket with its least and its greatest member; ``bands`` has key and node."""
    ends = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    met = bands.join(ends, "key")
    low = met.where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    high = met.where("node > low and node < high").select(F.col("node").alias("a"), F.col("high").alias("b"))
    return low.unionByName(high).distinct()


def mixed_buckets(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components and pairs that were not compared."""
    labelled = bands.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("members > 3 and c0 <> c1")
    return labelled.join(mixed.select("key", "members"), "key")


def left_over_links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between different components of a mixed bucket, all of whose pairs are compared, block by block.

    A pair that shares several buckets is looked at in the first of them, by
    the full band keys (the signatures have a byte a slot and may agree in a
    band in which the pair does not meet).  Once a link between two components is known in a
    block, further ones between them say nothing new and are skipped.
    """
    blocks = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # Block i meets block j in the group (key, i, j) with i <= j.
    dealt = (
        rows.join(nodes.select("node", "n", "signature", "bands"), "node")
        .join(sets, "node")
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "component", "n", "signature", "bands", "elements")
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(-1, SLOTS)
        node, comp, n, mine = (group[c].to_numpy() for c in ("node", "component", "n", "mine"))
        keys, elements = np.stack(group["bands"].tolist()), group["elements"].tolist()
        cross, band = group["i"].iloc[0] != group["j"].iloc[0], group["band"].iloc[0]
        comp, out = comp.copy(), []
        for k in range(len(group) - 1):
            rest = slice(k + 1, None)
            ok = (comp[rest] != comp[k]) & (np.minimum(n[rest], n[k]) >= threshold * np.maximum(n[rest], n[k]))
            if cross:
                ok &= mine[rest] != mine[k]
            at = np.flatnonzero(ok) + k + 1
            if not len(at):
                continue
            at = at[(sig[at] == sig[k]).mean(axis=1) >= LEAST_ESTIMATE]
            for m in at[(keys[at] == keys[k]).argmax(axis=1) == band].tolist():
                if comp[m] != comp[k] and overlap(elements[k], elements[m]) >= threshold:
                    out.append((node[k], node[m]))
                    comp[comp == comp[m]] = comp[k]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size, kept and text_key of every row of ``docs``.

    Classes are the components of the graph that links two texts whose
    similarity is ``threshold`` (at least 0.8) or more.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"the bands are made for a threshold of {THRESHOLD} or more")
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = scratch.table(features(texts.withColumn("row", F.monotonically_increasing_id()).withColumn("text_key", text_key("text"))))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    bags = scratch.table(found.where("n > 0").groupBy("bag", "bag2").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), best.alias("best")))
    nodes = scratch.table(found.select(F.col("row").alias("node"), "doc_id", "n", "bag", "bag2", "bands", "signature").join(bags.select("node"), "node", "left_semi"))
    bands = nodes.select(F.posexplode("bands").alias("band", "key"), "node")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    bands = scratch.table(bands.join(shared, "key", "left_semi"))

    def sets_of(ends: DataFrame) -> DataFrame:
        """Multisets of some nodes, from their texts once more."""
        wanted = nodes.join(ends, "node", "left_semi").select("node", "doc_id", "bag", "bag2")
        named = texts.join(wanted.select(F.col("doc_id").alias("wanted")).distinct(), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
        sets = multisets(named)
        same = sets["doc_id"].eqNullSafe(wanted["doc_id"]) & (sets["bag"] == wanted["bag"]) & (sets["bag2"] == wanted["bag2"])
        return scratch.table(slim(sets.join(wanted, same).select("node", "elements").dropDuplicates(["node"])))

    near = scratch.table(slim(estimated(star_pairs(bands), nodes)))
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    links = scratch.table(slim(verified(near, sets_of(ends), threshold)))
    labels = components(links)
    mixed = scratch.table(slim(mixed_buckets(bands, labels)))
    if mixed.take(1):
        more = left_over_links(mixed, nodes, sets_of(mixed.select("node").distinct()), threshold)
        labels = components(links.unionByName(scratch.table(more)))
    classed = bags.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    totals = classed.groupBy("component").agg(F.min("best").alias("best"), F.sum("copies").alias("size"))
    named = scratch.table(slim(classed.select("bag", "bag2", "component").join(totals, "component").select("bag", "bag2", "best", "size")))
    alone = found.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "text_key")
    grouped = (
        found.where("n > 0")
        .select("row", "doc_id", "bag", "bag2", "text_key")
        .join(named, ["bag", "bag2"])
        .select("doc_id", F.col("best.id").alias("class_id"), F.col("size").alias("class_size"), (F.col("best.row") == F.col("row")).alias("kept"), "text_key")
    )
    out = checkpoint(slim(grouped.unionByName(alone)))
    scratch.drop()
    return out


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each class."""
    return keep_rows(docs, near_duplicates(docs, doc_id, text, threshold), doc_id, text)
