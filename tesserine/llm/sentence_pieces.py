"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has a node at each character boundary and an edge for
each piece that fits.  ``stream`` moves over it once.  It holds back-pointers
for a window of as many boundaries as the longest piece has characters, since
no later edge starts before that; as soon as all paths that survive in the
window pass one boundary, the ids up to it are committed and forgotten.  So a
text of any length needs a window, not a lattice, of memory.

A unigram model has the path of the best sum of scores.  In a BPE model the
path is the one in which every two neighbours are what merging would have left
side by side; of each prefix there is one such path, so a boundary keeps one
back-pointer in either case.

A character at which no piece of the vocabulary crosses to the next is a
boundary at which all paths converge.  Texts are cut there with numpy, and the
search runs once for each distinct stretch that a worker meets; a stretch may
be as long as the text.  All ids come from this search; the library only reads
the model file, and the tests hold the search against it.

Defined results: null is the empty text, which has no pieces; repeated rows
are encoded each; other columns pass through, and one that has the name of the
result is replaced.  ``decode`` gives back the text exactly, but for the
character U+2581, which the vocabulary itself uses for a space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.blocks import Hasher, IdCache, ragged, text_blocks
from tesserine.llm.common import bound_batches

SPACE = "▁"
#: Unknown characters cost this much more than the worst piece of a unigram model.
UNKNOWN_COST = 10.0
#: Pairs of pieces of which it is remembered whether they may be neighbours.
KNOWN_PAIRS = 1_000_000


class PieceModel:
    """Pieces and scores of a model file with an identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            raw = file.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with an identity normaliser are supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.bpe = proto.trainer_spec.model_type == 2
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        normal = [i for i, k in enumerate(kinds) if k in (1, 4)]
        self.ids = {self.pieces[i]: i for i in normal}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == 6}
        self.unknown = next(i for i, k in enumerate(kinds) if k == 2)
        self.longest = max(len(p) for p in self.ids)
        self.worst = min(self.scores[i] for i in normal) - UNKNOWN_COST
        self.output = [b"" if k == 3 else bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.output[self.unknown] = " ⁇ ".encode()
        self.known: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        if self.bpe:
            for piece, i in self.ids.items():
                if (made := self._made_of(piece)) is not False:
                    self.halves[i] = made

    def _made_of(self, piece: str):
        """The last merge that makes ``piece``: its two halves, None for a character, False if merging never makes it."""
        parts = list(piece)
        while len(parts) > 2:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 1:
            return None
        a, b = (self.ids.get(p) for p in parts)
        return False if a is None or b is None else (a, b)

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in char.replace(SPACE, " ").encode()]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging would leave the pieces ``a`` and ``b`` side by side.

        Undoes the merges inside both, latest first, and asks at each state
        whether the two pieces at the border would have merged before the
        merge that was undone last.
        """
        pieces, scores, ids, halves = self.pieces, self.scores, self.ids, self.halves
        bound, open_bound = float("-inf"), False
        while True:
            crossing = ids.get(pieces[a] + pieces[b])
            if crossing is not None:
                score = scores[crossing]
                if score > bound or (open_bound and score == bound):
                    return False
            split_a, split_b = halves.get(a), halves.get(b)
            if split_a is None and split_b is None:
                return True
            # The merge of lower score came later; at equal scores the right one did.
            if split_b is None or (split_a is not None and scores[a] < scores[b]):
                bound, open_bound, a = scores[a], False, split_a[1]
            else:
                bound, open_bound, b = scores[b], True, split_b[0]


def stream(model: PieceModel, chars: Iterable[str]) -> Iterator[int]:
    """Ids of a normalised text, given character by character, each as soon as it is certain."""
    ids, scores, longest, neighbours, halves = model.ids, model.scores, model.longest, model.neighbours, model.halves
    bpe, known = model.bpe, model.known
    if len(known) > KNOWN_PAIRS:
        known.clear()
    window = ""
    start = 0
    # For each boundary from ``start`` on: (score, length of the last piece, its id or None for an unknown character).
    nodes: list[tuple[float, int, int | None] | None] = [(0.0, 0, None)]

    def commit(upto: int) -> list[int]:
        """Ids from ``start`` to the boundary ``upto``."""
        out, k = [], upto
        while k > start:
            _, size, piece = nodes[k - start]
            out.append(model.fallback(window[k - start - 1]) if piece is None else [piece])
            k -= size
        return [i for part in reversed(out) for i in part]

    end = 0
    for char in chars:
        window += char
        end += 1
        best = None
        for at in range(max(0, end - start - longest), end - start):
            before = nodes[at]
            if before is None:
                continue
            piece = ids.get(window[at:])
            if piece is None:
                continue
            size = end - start - at
            if bpe:
                if piece not in halves:
                    continue
                last = before[2]
                if last is not None:
                    pair = last << 32 | piece
                    good = known.get(pair)
                    if good is None:
                        good = known[pair] = neighbours(last, piece)
                    if not good:
                        continue
                # One path only is right; where scores tie, that with the longest last piece is taken.
                best = (0.0, size, piece)
                break
            else:
                score = before[0] + scores[piece]
                if best is None or score > best[0]:
                    best = (score, size, piece)
        if best is None and char not in ids:
            before = nodes[-1]
            best = (before[0] + model.worst, 1, None) if before is not None else None
        nodes.append(best)
        if end - start >= 2 * longest:
            # Where all paths that are still open meet.
            alive = {k for k in range(end - longest, end + 1) if nodes[k - start] is not None}
            while len(alive) > 1:
                k = max(alive)
                alive.discard(k)
                if k > start:
                    alive.add(k - nodes[k - start][1])
                else:
                    alive = {start}
            meet = alive.pop() if alive else start
            if meet > start:
                yield from commit(meet)
                window, nodes, start = window[meet - start :], nodes[meet - start :], meet
    yield from commit(end)


def own_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space for each U+2581, which is what it stands for."""
    mark = np.frombuffer(SPACE.encode(), np.uint8)
    at = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])) if len(data) > 2 else np.empty(0, np.int64)
    if not len(at):
        return data, offsets
    keep = np.ones(len(data), bool)
    keep[at + 1] = keep[at + 2] = False
    data = data.copy()
    data[at] = 0x20
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


class Encoder:
    """One worker's encoder of blocks of texts."""

    def __init__(self, path: str, cache: int = 1_000_000):
        self.model = PieceModel(path)
        self.cache, self.hasher = IdCache(cache), Hasher(31)
        joined = np.zeros((256, 256), bool)
        for piece in self.model.ids:
            raw = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
            joined[raw[:-1], raw[1:]] = True
        joined[:, 0x80:0xC0] = True
        self.joined = joined
        self.out_length = np.array([len(x) for x in self.model.output], np.int64)
        self.out_start = np.cumsum(self.out_length) - self.out_length
        self.out_bytes = np.frombuffer(b"".join(self.model.output), np.uint8)

    def encode_stretch(self, stretch: str) -> list[int]:
        return list(stream(self.model, stretch))

    def _learn(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.encode_stretch(s.decode("utf-8", "replace").replace(" ", SPACE)) for s in stretches]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and where each text's begin (one more)."""
        data, offsets = own_marks(data, offsets)
        sizes = np.diff(offsets)
        lead = (sizes > 0).astype(np.int64) * self.model.prefix
        moved = np.concatenate([[0], np.cumsum(sizes + lead)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        line = np.full(int(moved[-1]), 0x20, np.uint8)
        line[np.arange(len(data)) + (moved[:-1] + lead - offsets[:-1])[owner]] = data
        if not len(line):
            return np.empty(0, np.uint32), np.zeros(len(sizes) + 1, np.int64)
        cut = np.empty(len(line), bool)
        cut[0] = True
        np.logical_not(self.joined[line[:-1], line[1:]], out=cut[1:])
        cut[moved[:-1][sizes > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(line))
        entry = self.cache.entries(self.hasher.spans(self.hasher.table[line], start, end), line, start, end, self._learn)
        length = self.cache.length[entry]
        ids = self.cache.pool[ragged(self.cache.start[entry], length)]
        return ids, np.concatenate([[0], np.cumsum(length)])[np.searchsorted(start, moved)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each text's begin (one more)."""
        length = self.out_length[ids]
        at = np.concatenate([[0], np.cumsum(length)])[bounds]
        line = self.out_bytes[ragged(self.out_start[ids], length)]
        if not self.model.prefix:
            return line, at
        filled = np.diff(at) > 0
        first = at[:-1][filled]
        first = first[line[first] == 0x20]
        keep = np.ones(len(line), bool)
        keep[first] = False
        return line[keep], np.concatenate([[0], np.cumsum(keep)])[at]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as an array column."""
    kept = [c for c in docs.columns if c != to]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema) + f", `{to}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(text)):
                ids, bounds = model.ids(data, offsets)
                part = batch.slice(i, j - i).select(kept)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))], [*kept, to])

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text of an array column of ids; null ids give an empty text."""
    kept = [c for c in rows.columns if c != to]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema) + f", `{to}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            lists = [x or [] for x in batch.column(ids).to_pylist()]
            flat = np.array([i for x in lists for i in x], np.int64)
            line, at = model.decode(flat, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64))
            raw = line.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, to])

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def round_trips(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids) and whether decoding gives the text back."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text")):
                ids, bounds = model.ids(data, offsets)
                line, at = model.decode(ids, bounds)
                raw, back, packed = data.tobytes(), line.tobytes(), ids.astype("<u4").tobytes()
                same = [raw[offsets[k] : offsets[k + 1]] == back[at[k] : at[k + 1]] for k in range(j - i)]
                crc = [zlib.crc32(packed[4 * bounds[k] : 4 * bounds[k + 1]]) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets)), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names)

    bound_batches(docs.sparkSession)
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_pieces long, ids_crc32 long, round_trip boolean")
