"""Exact token counts of every prefix of a text.

``PrefixCounts`` stores the token count of each prefix of one text, by its
length in code points.  The rows come from a dynamic program over prefixes
(``WordBpe.prefixes``): the count of a prefix is that of the prefix up to its
last pre-token plus the row of that pre-token, and a row is built left to
right, each prefix from a shorter one.  Counts, truncation to a budget and
chunk limits are then look-ups; nothing is encoded again.  ``token_counts`` and
``truncate`` apply it to a DataFrame; over whole blocks the same table is kept
as counts at the ends of pre-tokens and one row for each distinct pre-token.

Defined results: null counts as the empty text, which has no tokens; repeated
rows are counted each; other columns of the input pass through, and a column
that has the name of a result is replaced by it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserine.llm.blocks import text_blocks
from tesserine.llm.common import bound_batches
from tesserine.llm.word_bpe import SPLIT_SUFFIXES, WordBpe


#: Characters of a run that are worth a look-up of the whole of it.
LEAST_RUN = 3


@lru_cache(2)
def tokenizer(path: str, rows: bool = True) -> WordBpe:
    return WordBpe(path, rows=rows)


def _kind(c: str) -> str:
    """The class of a character of which pre-tokens are runs; "" for others, and for the apostrophe."""
    if c.isalpha():
        return "letter"
    return "" if c.isspace() or c.isnumeric() or c == "'" or unicodedata.category(c)[0] not in "PS" else "mark"


def _composes(text: str, k: int) -> bool:
    """Whether the character at ``k`` may be composed with what is before it."""
    c = text[k]
    if c < "\u0300":
        return False
    if unicodedata.combining(c):
        return True
    before = text[max(0, k - 1) : k]
    return unicodedata.normalize("NFC", before + c) != unicodedata.normalize("NFC", before) + unicodedata.normalize("NFC", c)


class PrefixCounts:
    """The token count of each prefix of one text.

    ``counts[k]`` is the count of the first k code points, as the library would
    count that prefix alone; ``ends`` are the lengths that end with a pre-token.
    """

    def __init__(self, model: WordBpe, text: str | None):
        self.model, self.text = model, text or ""
        data = np.frombuffer(self.text.encode(), np.uint8)
        end, counts, entry, _, odd = model.prefix_block(data, np.array([0, len(data)]))
        if odd[0]:
            self._any_character()
        else:
            begins = np.flatnonzero((data & 0xC0) != 0x80)
            self.counts = np.zeros(len(self.text) + 1, np.int64)
            # Of each prefix: the last byte, the pre-token it is in or after, and its place there.
            last = np.append(begins[1:], len(data))[: len(begins)] - 1
            size = model.cache.key_length[entry]
            k = np.searchsorted(end - size, last, "right") - 1
            seen = k >= 0
            last, k = last[seen], k[seen]
            inside = np.minimum(last, end[k] - 1) - (end[k] - size[k])
            self.counts[1:][seen] = counts[k] + model.cache.row_pool[model.cache.key_start[entry[k]] + inside]
            self.ends = np.searchsorted(begins, end, "left")
        self.total = int(self.counts[-1])
        self.at_ends = self.counts[self.ends]

    def _any_character(self) -> None:
        """The table of a text whose pre-tokens numpy does not find, one piece between special tokens after the other."""
        self.counts, ends, begin, before = np.zeros(len(self.text) + 1, np.int64), [], 0, 0
        # All pre-tokens are learned at once; what is left to learn are prefixes that end otherwise.
        self.model.words([w for w in self.model.odd_pre_tokens(self.text) if not isinstance(w, int)])
        specials = [(m.start(), m.end()) for m in self.model.special_at.finditer(self.text)] if self.model.special_at else []
        for start, end in [*specials, (len(self.text), len(self.text))]:
            # Part of a special token's string is plain text, and joins what is before it.
            found, upto = self._plain(begin, start, max(start, end - 1), before)
            ends += found
            if end > start:
                before = upto + 1
                self.counts[end] = before
                ends.append(end)
            begin = end
        self.ends = np.array(ends, np.int64)

    def _plain(self, begin: int, end: int, more: int, before: int) -> tuple[list[int], int]:
        """Fill the counts after ``begin`` up to ``more``; the ends of pre-tokens up to ``end``, and the count there."""
        text, model = self.text, self.model
        ends, at, base = [], begin, before
        # A stretch from one safe place to the next holds at most one pre-token that is not closed.
        k = begin
        while k < more:
            if (stop := self._fill(at, k, end, base)) > k:
                k = stop
            k += 1
            words = model.plain_pre_tokens(text[at:k])
            self.counts[k] = base + self._count(words)
            if len(words) > 1 and k < end and self._letters(words[-1], k):
                # What is before these letters is settled: no apostrophe takes more than two along.
                at, base = k - len(words[-1].decode()), base + self._count(words[:-1])
                ends.append(at)
                words = words[-1:]
            if k > end or (k < end and _composes(text, k)):
                continue
            if k == end or not words or self._closes(at, k, words):
                if words:
                    ends.append(k)
                if k < end:
                    at, base = k, int(self.counts[k])
        return ends, int(self.counts[end])

    def _letters(self, word: bytes, k: int) -> bool:
        """Whether the pre-token is the letters before ``k``, more of them than an apostrophe takes."""
        word = word.decode("utf-8", "replace")
        own = self.text[max(0, k - len(word)) : k]
        return len(word) > 3 and own.isalpha() and own.lower() == word

    def _fill(self, at: int, k: int, end: int, base: int) -> int:
        """Fill the counts after ``k`` in a run of letters, or of marks, that begins at ``at``, from the row of the whole run; where it got to."""
        text = self.text
        if at >= end:
            return k
        kind = _kind(text[at])
        stop = at
        while kind and stop < end and _kind(text[stop]) == kind and (stop == at or not _composes(text, stop)):
            stop += 1
        if stop - k < LEAST_RUN:
            return k
        words = self.model.plain_pre_tokens(text[at:stop])
        size = np.array([len(c.lower().encode()) for c in text[at:stop]])
        if len(words) != 1 or len(words[0]) != size.sum():
            return k
        last = np.cumsum(size) - 1
        self.counts[k + 1 : stop] = base + self.model.row(words[0])[1][last[k - at : stop - 1 - at]]
        return stop - 1

    def _closes(self, at: int, k: int, words: list[bytes]) -> bool:
        """Whether a pre-token ends before ``k``: with the next character the words so far stay as they are."""
        stop = k + 1
        while stop < len(self.text) and _composes(self.text, stop):
            stop += 1
        further = self.model.plain_pre_tokens(self.text[at:stop])
        if further[: len(words)] != words:
            return False
        tail = self.text[k : k + 3].lower()
        # An apostrophe waits for the letters that it may take along.
        return not (words[-1] == b"'" and tail[:1].isalpha()) and not (words[-2:-1] == [b"'"] and any(f"'{words[-1].decode('utf-8', 'replace')}{tail}".startswith(s.decode()) for s in SPLIT_SUFFIXES))

    def _count(self, words: list[bytes]) -> int:
        return sum(self.model.row(w)[0] for w in words)

    def count(self, length: int) -> int:
        """Tokens of the first ``length`` code points."""
        return int(self.counts[max(0, min(length, len(self.text)))])

    def fit(self, budget: int) -> int:
        """Code points of the longest prefix that ends with a pre-token (or is all) and has at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        k = int(np.searchsorted(self.at_ends, budget, "right"))
        return int(self.ends[k - 1]) if k else 0


def _with(schema: T.StructType, fields: list[T.StructField], drop: set[str]) -> tuple[list[str], T.StructType]:
    new = {f.name for f in fields}
    kept = [f for f in schema.fields if f.name not in new | drop]
    return [f.name for f in kept], T.StructType([*kept, *fields])


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    kept, schema = _with(docs.schema, fields, set() if keep_text else {text})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            sizes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, _, data, offsets in text_blocks(batch.column(text)):
                sizes.append(np.diff(offsets))
                counts.append(model.counts(data, offsets))
            n = np.concatenate(counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.concatenate(sizes)), pa.array(n), pa.array(n > limit)], [*kept, *(f.name for f in fields)])

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def truncate(docs: DataFrame, path: str, budget: int, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` cut to the longest run of whole pre-tokens within ``budget`` tokens; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            cut = [None if x is None else x[: PrefixCounts(model, x).fit(budget)] for x in batch.column(text).to_pylist()]
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array(cut, batch.schema.field(at).type))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
