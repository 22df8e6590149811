"""A byte-level convolutional quality classifier in numpy.

``FILTERS`` learned filters of ``WIDTH`` bytes slide over the UTF-8 bytes of a
text.  Overlapping chunks of ``2 * STRIDE`` bytes, ``STRIDE`` apart, cover all
of it; each filter is max-pooled over a chunk, a small hidden layer looks at
the pooled values, and the mean and the maximum of its output over the chunks
of the text are combined into one probability.

A filter is a table of one value for each byte at each of its places, so the
convolution is a sum of look-ups.  Training is plain back-propagation with
Adam on a bounded sample: ``LEARN_TEXTS`` labelled rows at most, those with the
least hash of their id, as far as ``LEARN_BYTES`` go.  It is deterministic, and
what is learned or scored is always whole.

Defined results: a null or empty text is scored as one chunk without bytes;
without labels, or with labels of one kind only, the score is the share of
label 1 (0.5 without any).  Repeated rows are each scored.  A score depends on
the text alone: places behind its end are zero bytes, whatever stands next in
a batch.  A kept column that has the name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.blocks import text_blocks
from tesserine.llm.common import bound_batches

WIDTH, FILTERS, HIDDEN, STRIDE = 6, 12, 16, 128
LEARN_TEXTS = 3000
#: The sample ends with the text that fills so many bytes; it is learned whole, like the others.
LEARN_BYTES = 48 << 20
STEPS = 1000
BATCH = 24
RATE = 4e-3


def learn_sample(docs: DataFrame, labels: DataFrame, usable: Column, label: str, doc_id: str = "doc_id", text: str = "text", texts: int = LEARN_TEXTS, size: int = LEARN_BYTES):
    """(whole texts, labels) of the bounded sample; ``usable`` is a condition on the id column, the only one that ``labels`` shares with it."""
    chosen = labels.where(usable & F.col(label).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__label").limit(texts)
    # At most ``texts`` rows of two numbers.
    met = docs.select(F.col(doc_id).alias("__doc"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    first = met.select("t", "__id", "__label", F.xxhash64("__id").alias("__hash")).orderBy("__hash", "__id", "t").limit(texts)
    before = F.sum(F.octet_length("t")).over(Window.orderBy("__hash", "__id", "t").rowsBetween(Window.unboundedPreceding, -1))
    rows = first.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < size).orderBy("__hash", "__id", "t").collect()
    return [r["t"].encode() for r in rows], np.array([float(r["__label"]) for r in rows])


class Network:
    """Parameters and the forward pass."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS))
        self.p = {
            "table": table,
            "bias": np.zeros(FILTERS),
            "u": rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)),
            "c": np.full(HIDDEN, 0.1),
            "mean": rng.normal(0, 0.3, HIDDEN),
            "max": rng.normal(0, 0.3, HIDDEN),
            "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at each byte of ``data``, which has WIDTH - 1 bytes more at its end."""
        n = len(data) - WIDTH + 1
        out = self.p["table"][0][data[:n]]
        for j in range(1, WIDTH):
            out += self.p["table"][j][data[j : j + n]]
        return out

    def layout(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of STRIDE bytes of each text and at least WIDTH - 1 zero bytes: their number, and the first of each text."""
        blocks = (sizes + WIDTH - 1 + STRIDE - 1) // STRIDE
        return blocks, np.cumsum(blocks) - blocks

    def pooled(self, data: np.ndarray, offsets: np.ndarray, places: bool = False):
        """Maxima over chunks, ReLU'd; text of each chunk; with ``places``, where in the padded line each maximum is.

        A filter at the last bytes of a text reads the zero bytes after it; a
        place behind those reads the next text and is left out of the maxima.
        """
        sizes = np.diff(offsets)
        blocks, first = self.layout(sizes)
        line = np.zeros(int(blocks.sum()) * STRIDE + WIDTH, np.uint8)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        line[np.arange(len(data)) + (first * STRIDE - offsets[:-1])[owner]] = data
        # Places of the last block that count: those whose window ends in it.
        counted = np.full(int(blocks.sum()), STRIDE)
        counted[first + blocks - 1] = STRIDE - WIDTH + 1
        tops = np.empty((int(blocks.sum()), FILTERS), np.float32)
        where = np.empty(tops.shape, np.int64) if places else None
        step = 512
        for k in range(0, len(tops), step):
            m = min(step, len(tops) - k)
            r = self.responses(line[k * STRIDE : (k + m) * STRIDE + WIDTH - 1]).reshape(m, STRIDE, FILTERS)
            r[:, STRIDE - WIDTH + 1 :][counted[k : k + m] < STRIDE] = -np.inf
            if places:
                at = r.argmax(axis=1)
                where[k : k + m] = at + (np.arange(k, k + m) * STRIDE)[:, None]
                tops[k : k + m] = np.take_along_axis(r, at[:, None], axis=1)[:, 0]
            else:
                tops[k : k + m] = r.max(axis=1)
        text = np.repeat(np.arange(len(sizes)), blocks)
        # A chunk is a block and the one after it in the same text.
        follows = np.arange(len(text)) + np.append(text[1:] == text[:-1], False)
        second = tops[follows] > tops
        chunk = np.where(second, tops[follows], tops) + self.p["bias"]
        if places:
            where = np.where(second, where[follows], where)
        return np.maximum(chunk, 0), text, first, blocks, line, where

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        chunk, _, first, blocks, _, _ = self.pooled(data, offsets)
        # Sums in an order that the batch does not change: not by a matrix product of all rows.
        hidden = np.repeat(self.p["c"][None], len(chunk), axis=0)
        for f in range(FILTERS):
            hidden += chunk[:, f : f + 1] * self.p["u"][f]
        hidden = np.maximum(hidden, 0)
        total = np.add.reduceat(hidden, first, axis=0) / blocks[:, None]
        logit = (total * self.p["mean"] + np.maximum.reduceat(hidden, first, axis=0) * self.p["max"]).sum(axis=1) + self.p["b"]
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def gradients(self, data: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        chunk, text, first, blocks, line, where = self.pooled(data, offsets, places=True)
        before = chunk @ self.p["u"] + self.p["c"]
        hidden = np.maximum(before, 0)
        mean = np.add.reduceat(hidden, first, axis=0) / blocks[:, None]
        top = np.maximum.reduceat(hidden, first, axis=0)
        logit = mean @ self.p["mean"] + top @ self.p["max"] + self.p["b"]
        d = ((1 / (1 + np.exp(-logit)) - label) * weight / len(label)).astype(np.float32)
        g = {"mean": mean.T @ d, "max": top.T @ d, "b": d.sum(keepdims=True)}
        d_hidden = (d / blocks)[text][:, None] * self.p["mean"] + np.where(hidden == top[text], d[text][:, None] * self.p["max"], 0)
        d_hidden *= before > 0
        g["u"], g["c"] = chunk.T @ d_hidden, d_hidden.sum(axis=0)
        d_chunk = (d_hidden @ self.p["u"].T) * (chunk > 0)
        g["bias"] = d_chunk.sum(axis=0)
        g["table"] = np.zeros_like(self.p["table"])
        for j in range(WIDTH):
            byte = line[where + j]
            for f in range(FILTERS):
                g["table"][j, :, f] = np.bincount(byte[:, f], d_chunk[:, f], 256)
        return g


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> Network:
    """A network fitted to labelled texts in about ``steps`` steps, however many there are; a label weighs by the root of its inverse share."""
    net = Network(seed)
    if len(set(labels.tolist())) < 2:
        net.constant = float(labels.mean()) if len(labels) else 0.5
        return net
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    t = 0
    weight = np.sqrt(np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())))
    epochs = max(1, round(steps * BATCH / len(texts)))
    steps = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            data = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in some])])
            t += 1
            rate = RATE * (1 - 0.95 * t / steps)
            for name, g in net.gradients(data, offsets, labels[some], weight[some]).items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                net.p[name] -= (rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def classify(docs: DataFrame, net: Network, keep: list[Column], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``keep`` and score and predicted of every row."""
    names = docs.select(*keep).columns
    frame = docs.select(*(c.alias(f"c{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    own = [f"c{i}" for i, c in enumerate(names) if c not in ("score", "predicted")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(own).schema)
    schema = ", ".join([*([schema] if own else []), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0)]
            found.extend(net.scores(data, offsets) for _, _, data, offsets in text_blocks(batch.column("text")))
            score = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*own, "score", "predicted"])

    bound_batches(docs.sparkSession)
    return frame.mapInArrow(run, schema).select(*(F.col(c).alias(names[int(c[1:])]) for c in own), "score", "predicted")
