"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is
parsed from left to right into phrases, each the longest match that occurs in
that language's text; phrases times log2 of the size of the learned text is
its cross-parsing length, and the language with the least of it wins.

The automaton is completed to a table over (state, symbol) in which a missing
transition starts the next phrase, so the parse is a plain table walk.  Texts
are walked side by side in stretches of ``STRETCH`` symbols that cover all of
them, one numpy step for the next symbol of every stretch.  A stretch first
starts at the root; then, from the state in which the one before it ended, its
beginning is walked again until it is in the same state as the first time (two
walks that start a phrase at the same place are one from there on), and so on
until no stretch starts anew.  So the phrases are those of one walk over the text.

What is learned is a bounded sample: of each language ``LEARN_TEXTS`` texts at
most, those with the least hash of their id.  Texts of any length are cut into
pieces of ``PIECE`` code points, and of these, in the order of a hash, as many are
taken as ``LEARN_BYTES`` bytes hold, so the sample is from all over the texts.
Texts in ``held_out`` are never used.

Defined results: ``und`` with score 0 for a null text, one without a letter,
or if no language is learned; ties go to the first language by name.  Repeated
rows are each predicted; a kept column that has the name of a result is
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.blocks import text_blocks
from tesserine.llm.common import bound_batches

LEARN_TEXTS = 64
LEARN_BYTES = 48_000
#: Code points of the pieces that learned texts are cut into, of which the sample takes some from all over the text.
PIECE = 1000
STRETCH = 1024
UNKNOWN = "und"


def learn_sample(docs: DataFrame, held_out: Column, doc_id: str, text: str, lang: str, texts: int = LEARN_TEXTS, size: int = LEARN_BYTES) -> dict[str, bytes]:
    """Lower-cased labelled text of each language: pieces of ``texts`` texts, in the order of a hash, ``size`` bytes at most."""
    usable = docs.where(~held_out & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("hash", "text")
    ranked = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("hash")).withColumn("rank", F.row_number().over(order))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int")), lambda i: F.struct(i.alias("i"), F.lower(F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE))).alias("text")))
    cut = ranked.where(F.col("rank") <= texts).select("lang", "rank", F.explode(pieces).alias("piece")).select("lang", "rank", "piece.*").where(F.col("text").rlike(r"\p{L}"))
    hashed = Window.partitionBy("lang").orderBy(F.xxhash64("rank", "i"), "rank", "i")
    upto = F.sum(F.octet_length("text") + 1).over(hashed.rowsBetween(Window.unboundedPreceding, 0))
    some = cut.withColumn("upto", upto).where(F.col("upto") <= size)
    sample: dict[str, list[str]] = {}
    for r in some.orderBy("lang", "upto").collect():
        sample.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(found).encode() for lang, found in sorted(sample.items())}


class Symbols:
    """Letters and bytes above ASCII as small numbers; a run of anything else is one separator, 0."""

    def __init__(self, learned: list[bytes]):
        seen = sorted({b for x in learned for b in x if b >= 0x80 or chr(b).isalpha()})
        self.table = np.zeros(256, np.uint8)
        self.table[seen] = np.arange(1, len(seen) + 1)
        unseen = [b for b in range(256) if (b >= 0x80 or chr(b).isalpha()) and b not in set(seen)]
        self.table[unseen] = len(seen) + 1
        self.size = len(seen) + 2

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = self.table[data]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        return symbols[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """The completed table: entry state * size + symbol holds next state * 2 + (1 if a new phrase starts)."""
    link, length, following = [-1], [0], [{}]
    last = 0
    for c in symbols:
        here = len(length)
        length.append(length[last] + 1)
        link.append(0)
        following.append({})
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = here
            p = link[p]
        if p != -1:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                following.append(dict(following[q]))
                while p != -1 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    start = np.ones(size, np.int32)
    for c, s in following[0].items():
        start[c] = 2 * s + 1
    table = np.tile(start, (len(length), 1))
    rows = np.repeat(np.arange(len(length)), [len(f) for f in following])
    columns = np.fromiter((c for f in following for c in f), np.int64, len(rows))
    table[rows, columns] = 2 * np.fromiter((s for f in following for s in f.values()), np.int64, len(rows))
    # From the root the first symbol always starts a phrase.
    table[0] = start
    return table.ravel()


@lru_cache(2)
def automata(learned: tuple[bytes, ...]) -> tuple[Symbols, list[np.ndarray], np.ndarray]:
    symbols = Symbols(list(learned))
    parts = [symbols.of(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in learned]
    return symbols, [suffix_automaton(p.tolist(), symbols.size) for p in parts], np.log2([len(p) + 2 for p in parts])


def walk(table: np.ndarray, size: int, lanes: np.ndarray, live: np.ndarray, state: np.ndarray, trace: np.ndarray, count: np.ndarray, known: bool) -> np.ndarray:
    """Walk each stretch from ``state``, and keep the entry at each step in ``trace`` and the phrases in ``count``; returns the last states.

    With ``known`` they were walked before from other states: a stretch stops
    where the state is the one of the last time, from where on all is known.
    """
    n, end = lanes.shape[1], state.copy()
    if not known:
        count[:] = 0
        for k, m in enumerate(live.tolist()):
            if not m:
                break
            entry = table[state[:m] * size + lanes[k, :m]]
            trace[k, :m] = entry
            count[:m] += entry & 1
            state[:m] = entry >> 1
        return state
    left = np.arange(n)
    for k, m in enumerate(live.tolist()):
        left = left[left < m]
        if not len(left):
            break
        entry = table[state[left] * size + lanes[k, left]]
        old = trace[k, left]
        trace[k, left] = entry
        count[left] += (entry & 1) - (old & 1)
        state[left] = entry >> 1
        end[left] = state[left]
        left = left[(entry >> 1) != (old >> 1)]
    return end


def phrases(table: np.ndarray, size: int, lanes: np.ndarray, lengths: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Phrases of each stretch; ``lanes`` has a row a step, stretches longest first; ``after`` names the stretch before each, -1 if there is none."""
    n = lanes.shape[1]
    live = np.searchsorted(-lengths, -np.arange(len(lanes)), "left")
    trace, count = np.zeros(lanes.shape, np.int32), np.zeros(n, np.int64)
    begun = np.zeros(n, np.int64)
    ended = walk(table, size, lanes, live, begun.copy(), trace, count, False)
    while after is not None:
        begin = np.where(after >= 0, ended[after], 0)
        again = np.flatnonzero(begin != begun)
        if not len(again):
            break
        # Stretches stay longest first.
        part, counted = np.ascontiguousarray(trace[:, again]), count[again]
        walk(table, size, lanes[:, again], np.searchsorted(-lengths[again], -np.arange(len(lanes)), "left"), begin[again].copy(), part, counted, True)
        trace[:, again], count[again], begun = part, counted, begin
        ended[again] = part[lengths[again] - 1, np.arange(len(again))] >> 1
    return count


def cross_parse(learned: tuple[bytes, ...], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cross-parsing length in bits of each text of a block under each language."""
    symbols, tables, bits = automata(learned)
    line, at = symbols.of(data, offsets)
    sizes = np.diff(at)
    pieces = -(-sizes // STRETCH)
    text = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = at[:-1][text] + nth * STRETCH
    length = np.minimum(STRETCH, at[1:][text] - start)
    order = np.argsort(-length, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    after = np.where(nth > 0, place[np.arange(len(text)) - 1], -1)[order]
    text, start, length = text[order], start[order], length[order]
    out = np.zeros((len(sizes), len(tables)))
    if not len(text):
        return out
    padded = np.concatenate([line, np.zeros(STRETCH, np.uint8)])
    lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, int(length[0]))[start].T)
    for k, table in enumerate(tables):
        out[:, k] = np.bincount(text, phrases(table, symbols.size, lanes, length, after), len(sizes)) * bits[k]
    return out


def identify(docs: DataFrame, learned: dict[str, bytes], keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` and lang_pred and score of every row."""
    names, samples = list(learned), tuple(learned.values())
    kept = docs.select(*keep).columns
    frame = docs.select(*(c.alias(f"c{i}") for i, c in enumerate(keep)), F.lower(F.col(text)).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    own = [f"c{i}" for i, c in enumerate(kept) if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(own).schema)
    schema = ", ".join([*([schema] if own else []), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if names:
                for i, j, data, offsets in text_blocks(batch.column("text"), 2 << 20):
                    cost = cross_parse(samples, data, offsets)
                    best[i:j] = cost.argmin(axis=1)
                    least = cost.min(axis=1, keepdims=True)
                    weight = np.exp(-(cost - least) / (0.1 * least + 1))
                    score[i:j] = 1 / weight.sum(axis=1)
            known = letters & bool(names)
            lang = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0))], [*own, "lang_pred", "score"])

    bound_batches(docs.sparkSession)
    return frame.mapInArrow(run, schema).select(*(F.col(c).alias(kept[int(c[1:])]) for c in own), "lang_pred", "score")
