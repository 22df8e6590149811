"""Runs of words that repeat with a period, by counts of matches at each lag.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) of at least ``least`` words and two periods, which no neighbouring
word extends.  A run of period q has q or more consecutive matches at lag q (and
``least - q``), so lags with fewer matches in the whole text need no scan.

Matches are counted for lags of one octave after the other.  Only words in
windows that occur twice can be in a run (windows of the octave's least lag, or
half of ``least``); the others are left out.  Of those that are left, matches of
rare words are differences of pairs of places, nearest first, for a whole block
of texts at once; a word for which that would be dearer than a transform gives
its matches by the exact autocorrelation of its places, by FFT (counts are below
2**53 by far, and rounded).  What runs of a shorter period explain at the
multiples of it is subtracted.  A lag that still has enough matches gets one scan
for islands of them.

Defined results: null and texts without words have no runs, and null stays null;
repeated rows are treated each; other columns pass through, and one that has the
name of a result (n_words, runs, collapsed) is replaced by it.  Words are numbered
by a dictionary of the text, so equal hashes cannot make them equal.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserine.llm.blocks import Hasher
from tesserine.llm.common import bound_batches

LEAST = 12
#: Words of the texts that are searched together, and bytes of a text that are split at a time.
BLOCK_WORDS = 1 << 17
SPLIT_BYTES = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"

Run = tuple[int, int, int]


def number_words(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers in order of first appearance, and the distinct words; the text is split piece by piece."""
    numbers: dict[bytes, int] = {}
    out, at = array("i"), 0
    while at < len(raw):
        end = min(len(raw), at + SPLIT_BYTES)
        while end < len(raw) and raw[end] not in SPACES:
            end += 1
        out.extend([numbers.setdefault(w, len(numbers)) for w in raw[at:end].split()])
        at = end
    return np.frombuffer(out, np.int32) if len(out) else np.empty(0, np.int32), list(numbers)


class Windows:
    """Names of the windows of all places of a block, of growing size; only places whose window is found twice keep one."""

    def __init__(self, words: np.ndarray, size: int):
        self.hasher, self.n, self.size = Hasher(11), len(words), 1
        self.name = self.hasher.join(words.astype(np.uint64), words.astype(np.uint64) + np.uint64(1))
        self.at = np.arange(self.n)
        self.grow(size)

    def grow(self, size: int) -> None:
        """Windows of ``size`` words, of which this one's doubled cover what is missing."""
        while self.size < size:
            step = min(self.size, size - self.size)
            # A longer window is found twice only where both its parts are.
            place = np.full(self.n + 1, -1, np.int64)
            place[self.at] = np.arange(len(self.at))
            follow = place[np.minimum(self.at + step, self.n)]
            kept = np.flatnonzero(follow >= 0)
            name, self.at = self.hasher.join(self.name[kept], self.name[follow[kept]]), self.at[kept]
            self.size += step
            # Windows up to the size of a name's parts overlap; the step tells them apart.
            self.name = name + np.uint64(step)
            self._repeated()
            if not len(self.at):
                self.size = size

    def _repeated(self) -> None:
        order = np.argsort(self.name, kind="stable")
        same = self.name[order[1:]] == self.name[order[:-1]]
        twice = np.zeros(len(self.at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        self.name, self.at = self.name[twice], self.at[twice]

    def covered(self) -> np.ndarray:
        """Places in any window that is found twice, in order."""
        edge = np.zeros(self.n + 1, np.int32)
        np.add.at(edge, self.at, 1)
        np.add.at(edge, self.at + self.size, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]))


class Lags:
    """Counts of matches at each lag of each text of a block, an octave of lags at a time."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.words, self.first = words, first
        #: A text has lags up to half its words; ``base`` is where lag 0 of each is.
        self.half = np.diff(first) // 2
        self.base = np.concatenate([[0], np.cumsum(self.half + 1)])
        self.counts = np.zeros(int(self.base[-1]), np.int64)

    def add(self, live: np.ndarray, low: int, high: int) -> None:
        """Count matches at lags ``low`` to ``high`` - 1 between the places ``live``."""
        text = np.searchsorted(self.first, live, "right") - 1
        fits = self.half[text] >= low
        live, text = live[fits], text[fits]
        if not len(live):
            return
        order = np.argsort(self.words[live], kind="stable")
        place, text, word = live[order], text[order], self.words[live][order]
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(starts, len(word)))
        # A step of a pair costs about eight of the N log N of a transform; a word has at most its places times those within reach.
        length = 1 << np.ceil(np.log2(np.diff(self.first)[text[starts]] + high)).astype(np.int64)
        heavy = 8 * size * np.minimum(size, high) > length * np.log2(length)
        rare = ~np.repeat(heavy, size)
        self._pairs(place[rare], text[rare], word[rare], low, high)
        for t in np.unique(text[starts[heavy]]):
            mine = np.flatnonzero(heavy & (text[starts] == t))
            self._transform(int(t), [place[starts[k] : starts[k] + size[k]] for k in mine], low, high)

    def _pairs(self, place: np.ndarray, text: np.ndarray, word: np.ndarray, low: int, high: int) -> None:
        most = np.minimum(self.half[text], high - 1)
        at, k, found, waiting = np.arange(len(place)), 1, [], 0
        while len(at):
            at = at[at + k < len(place)]
            lag = place[at + k] - place[at]
            near = (word[at + k] == word[at]) & (lag <= most[at])
            at, lag = at[near], lag[near]
            hit = lag >= low
            found.append(self.base[text[at[hit]]] + lag[hit])
            waiting += len(found[-1])
            if waiting > len(self.counts):
                self._tally(found)
                found, waiting = [], 0
            k += 1
        self._tally(found)

    def _tally(self, found: list[np.ndarray]) -> None:
        keys = np.concatenate([np.empty(0, np.int64), *found])
        if 8 * len(keys) > len(self.counts):
            self.counts += np.bincount(keys, minlength=len(self.counts))
        else:
            np.add.at(self.counts, keys, 1)

    def _transform(self, text: int, places: list[np.ndarray], low: int, high: int) -> None:
        """Of words of one text: the sum of their power spectra goes back to lags at once."""
        n = int(self.first[text + 1] - self.first[text])
        high = min(high, int(self.half[text]) + 1)
        size = 1 << (n + high - 1).bit_length()
        power = np.zeros(size // 2 + 1)
        for at in places:
            there = np.zeros(size)
            there[at - self.first[text]] = 1
            spectrum = np.fft.rfft(there)
            power += spectrum.real**2
            power += spectrum.imag**2
        lags = np.fft.irfft(power, size)[low:high]
        self.counts[self.base[text] + low : self.base[text] + high] += np.rint(lags).astype(np.int64)

    def enough(self, low: int, high: int, least: int) -> np.ndarray:
        """Places in ``counts`` of the octave's lags with enough matches, by text and lag."""
        begin, end = np.minimum(self.base[:-1] + low, self.base[1:]), np.minimum(self.base[:-1] + high, self.base[1:])
        size = end - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        lag = at - np.repeat(self.base[:-1], size)
        return at[self.counts[at] >= np.maximum(lag, least - lag)]


def islands(words: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, matches) of the stretches of at least ``least`` matches at ``lag``."""
    match = np.zeros(len(words) - lag + 2, bool)
    np.equal(words[:-lag], words[lag:], out=match[1:-1])
    edge = np.flatnonzero(match[1:] != match[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    long = size >= least
    return list(zip(start[long].tolist(), size[long].tolist(), strict=True))


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> list[list[Run]]:
    """(start, length, period) of the runs of each text of a block, by start and period.

    ``first`` has the place of each text's first word (one more); equal numbers
    are equal words, and no two texts share one.
    """
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(first) - 1)]
    low = (least + 1) // 2
    windows, lags, longest = Windows(words, low), Lags(words, first), int(np.diff(first).max(initial=0)) // 2
    begin, high = 1, least
    while len(windows.at) and begin <= longest:
        lags.add(windows.covered(), begin, high)
        for at in lags.enough(begin, high, least).tolist():
            text = int(np.searchsorted(lags.base, at, "right")) - 1
            lag = at - int(lags.base[text])
            need = max(lag, least - lag)
            if lags.counts[at] < need:  # explained by now
                continue
            runs = found[text]
            for start, matches in islands(words[first[text] : first[text + 1]], lag, need):
                length = matches + lag
                # Lags come in ascending order: what is known has a shorter period.
                if runs.setdefault((start, length), lag) == lag:
                    multiples = np.arange(2 * lag, length // 2 + 1, lag)
                    lags.counts[lags.base[text] + multiples] -= length - multiples
        begin, high = high, 2 * high
        windows.grow(begin)
    return [sorted((s, n, q) for (s, n), q in runs.items()) for runs in found]


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words are in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _joined(words: np.ndarray, names: list[bytes]) -> bytes:
    return b" ".join([names[k] for k in words.tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, runs (start, length and period in words) and collapsed: the words outside of repetitions, joined by one space."""
    run_type = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type, False)), T.StructField("collapsed", T.StringType())]
    new = {f.name.lower() for f in fields} | (set() if keep_text else {text.lower()})
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    arrow_run = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def block(numbered: list[tuple[np.ndarray, list[bytes]]]) -> Iterator[tuple[list[Run], str]]:
        """Runs and collapsed texts of texts that are searched together."""
        first = np.concatenate([[0], np.cumsum([len(w) for w, _ in numbered])])
        shift = np.concatenate([[0], np.cumsum([len(names) for _, names in numbered])])
        words = np.concatenate([w.astype(np.int64) + shift[k] for k, (w, _) in enumerate(numbered)])
        for (own, names), runs in zip(numbered, find_runs(words, first, least), strict=True):
            yield runs, _joined(own[~dropped(len(own), runs)] if runs else own, names).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, sizes, results, some, n = batch.column(text), [], [], [], 0
            for value in column:
                numbered = number_words((value.as_py() or "").encode())
                if some and n + len(numbered[0]) > BLOCK_WORDS:
                    results += block(some)
                    some, n = [], 0
                some.append(numbered)
                n += len(numbered[0])
                sizes.append(len(numbered[0]))
            if some:
                results += block(some)
            there = column.is_valid().to_pylist()
            runs = pa.array([[{"start": s, "length": m, "period": q} for s, m, q in r] for r, _ in results], arrow_run)
            texts = pa.array([t if ok else None for (_, t), ok in zip(results, there, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(sizes, pa.int64()), runs, texts], [*(f.name for f in kept), *(f.name for f in fields)])

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*kept, *fields]))
