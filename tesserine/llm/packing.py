"""Best-fit packing of token pieces into sequences of a fixed size.

A text's ids and a closing id are cut into full pieces and a rest.  Full
pieces are sequences of their own; a rest (at most one a document) is packed
by bounded-space online best fit: ``OPEN_BINS`` bins are open at most, a
bitset has a bit for each amount of free space that an open bin has, the
lowest bit that is high enough names the tightest bin, and when a bin must
open while all are in use, the fullest one (the lowest bit) closes.

Rests are dealt by hash over shards of about ``SHARD_ROWS`` pieces, which arrive
longest first and are packed in parallel, as rows of a number and a length; ids
and other columns meet their place at the end.  Bins still open when a shard ends,
with more than 1/64 of their space free, are not wasted: they are the items of
the next round, in which ``MERGE`` shards meet, and so on to the root, so a
task sees at most MERGE * OPEN_BINS bins whatever the input size.
Each round is written to the checkpoint folder.

Defined results: a null or empty text is the closing id alone; repeated rows
are packed each; a null doc_id is kept; further columns of the input are not
read, and columns of pieces that have the name of a result are replaced by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.blocks import text_blocks
from tesserine.llm.common import bound_batches, checkpoint
from tesserine.llm.token_counts import tokenizer

SIZE = 2048
END_ID = 0
OPEN_BINS = 16_384
SHARD_ROWS = 50_000
MERGE = 8


class BestFit:
    """Online best fit with a bounded number of open bins; bins are numbered as they open."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.bits, self.n_open, self.n_bins = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        chosen = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """The bin of an item and its place there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            free, chosen = self.size, self.n_bins
            self.n_bins += 1
            self.n_open += 1
        left = free - length
        if left:
            self.by_free[left].append(chosen)
            self.bits |= 1 << left
        else:
            self.n_open -= 1
        return chosen, self.size - free

    def still_open(self, least_free: int) -> list[int]:
        """Open bins with at least so much free space."""
        return [b for bins in self.by_free[least_free:] for b in bins]


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long{ids}"


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: full ones and the rest; with their ids if asked for."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path, rows=False)
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text")):
                ids, first = model.ids(data, offsets, [END_ID])
                ids = ids.astype("<u4")
                counts = -(-np.diff(first) // size)
                row = np.repeat(np.arange(j - i), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * size
                length = np.minimum(size, np.diff(first)[row] - start)
                at = (first[:-1][row] + start).tolist()
                spans = [ids[a : a + n] for a, n in zip(at, length.tolist(), strict=True)]
                out = [
                    batch.column("doc_id").take(pa.array(row + i)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start.astype(np.int64)),
                    pa.array(length.astype(np.int64)),
                    pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([x.astype(np.int32) for x in spans], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    bound_batches(docs.sparkSession)
    return slim.mapInArrow(run, PIECES.format(id=id_type, ids=", ids array<int>" if with_ids else ""))


def _round(rows: DataFrame, size: int, open_bins: int, last: bool) -> DataFrame:
    """Pack the bins of each shard, longest first; a bin's rows keep their order inside it."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__order", "__bin", "offset"], kind="stable", ignore_index=True)
        new = (group["__bin"] != group["__bin"].shift()) | (group["__order"] != group["__order"].shift())
        item = new.cumsum().to_numpy() - 1
        lengths = np.bincount(item, group["length"]).astype(int)
        fit = BestFit(size, open_bins)
        bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for i in np.argsort(-lengths, kind="stable").tolist():
            bins[i], offsets[i] = fit.place(int(lengths[i]))
        left = np.zeros(fit.n_bins, bool)
        if not last:
            left[fit.still_open(size // 64)] = True
        group["offset"] += offsets[item]
        group["__bin"] = bins[item]
        group["__open"] = left[bins[item]]
        return group

    return rows.groupBy("__shard").applyInPandas(pack, rows.schema)


def pack(pieces: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS, shard_rows: int = SHARD_ROWS, merge: int = MERGE) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any more) with sequence_id and offset.

    ``length`` is between 1 and ``size``.  Numbers of sequences are not dense.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # As its files are read back, so are the numbers.
    pieces = checkpoint(pieces.select(own).withColumn("__row", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("__row")).withColumn("offset", F.lit(0).cast("long"))
    rests = pieces.where(F.col("length") < size)
    shards = max(1, -(-rests.count() // shard_rows))
    key = F.xxhash64("__row")
    rows = rests.select(
        "__row",
        "length",
        F.xxhash64(key, F.lit(7)).alias("__order"),
        F.col("__row").alias("__bin"),
        F.lit(0).cast("long").alias("offset"),
        F.pmod(key, F.lit(shards)).alias("__shard"),
        F.lit(True).alias("__open"),
    )
    done, level = [], 0
    while True:
        last = shards == 1
        packed = checkpoint(_round(rows, size, open_bins, last))
        # A sequence is numbered by the round, the shard and the bin that closed it.
        number = F.lit(level << 56) + F.shiftleft(F.col("__shard").cast("long"), 28) + F.col("__bin")
        done.append(packed.where(~F.col("__open")).select("__row", number.alias("sequence_id"), "offset"))
        if last:
            break
        shards, level = -(-shards // merge), level + 1
        rows = packed.where("__open").withColumn("__order", F.xxhash64("__shard", "__bin")).withColumn("__shard", F.floor(F.col("__shard") / merge))
    places = done[0]
    for part in done[1:]:
        places = places.unionByName(part)
    return full.unionByName(rests.join(places, "__row").select(full.columns)).drop("__row")


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``."""
    return pack(token_pieces(docs, path, size, doc_id, text, with_ids), size)
