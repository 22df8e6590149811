"""Token ids and prefix counts of many whole texts by a lower-casing word-level BPE vocabulary.

No merge of such a vocabulary crosses a pre-token, so the ids of a text are
those of its pre-tokens, one after the other.  The ids of a pre-token, and the
token counts of all its prefixes, come from one dynamic program over it
(``WordBpe.prefixes``), run once for each distinct pre-token a worker meets.
Where only ids are wanted (``rows=False``) the library is asked for them once
for each distinct pre-token.

Pre-tokens of texts in ASCII and the Latin-1 letters are found with numpy.  In
texts with any other character, a control character or the string of a special
token the library's normaliser and pre-tokeniser find them (``rows=False``:
the library gets the whole text).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

from tesserine.llm.blocks import Hasher, IdCache, ragged

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x21:0x7F] = MARK
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[ord("0") : ord("9") + 1] = DIGIT
    table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = LETTER
    table[0xC3] = table[0x80:0xC0] = LETTER
    return table


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


CLASS, LOWER = _classes(), _lower()
# What an apostrophe at the start of a pre-token may take along.
SUFFIXES = ["s", "t", "m", "d", "re", "ve", "ll"]
SPLIT_SUFFIXES = {f"'{x}".encode() for x in SUFFIXES if len(x) > 1}
END_OF_WORD = "</w>"
#: Pairs of pieces of which it is remembered whether they may be neighbours.
KNOWN_PAIRS = 1_000_000
#: Pre-tokens of so many bytes of which the row of prefix counts is at hand.
KNOWN_ROWS, KNOWN_BYTES = 50_000, 64


def byte_names() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + k): b for k, b in enumerate(rest)}}


class WordBpe:
    """One worker's tokenizer of blocks of texts; without ``rows`` the library gives the ids of new pre-tokens."""

    def __init__(self, path: str, cache: int = 1_000_000, rows: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.rows = rows
        self.library = library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.special_ids = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.special = [x.encode() for x in self.special_ids]
        self.special_at = re.compile("|".join(map(re.escape, self.special_ids))) if self.special_ids else None
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.cache, self.hasher = IdCache(cache), Hasher(3)
        if not rows:
            vocabulary = library.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(END_OF_WORD)]] = True
            return
        self._vocabulary(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])

    def _vocabulary(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        names = byte_names()
        self.names = names
        #: Of a piece that a merge makes: its two halves and the number of the merge.
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        raw: dict[int, bytes] = {}
        ends: dict[int, bool] = {}
        made = {a + b for a, b in merges}
        if len(made) < len(merges):
            raise ValueError("only vocabularies in which one merge makes a piece are supported")
        for piece, i in vocab.items():
            if piece not in made and piece not in self.special_ids:
                ends[i] = len(piece) > 1
                raw[i] = bytes([names[piece[0]]])
                self.rank[i] = -1
        for rank, (a, b) in enumerate(merges):
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            self.halves[i], self.rank[i], self.merged[x, y] = (x, y), rank, rank
            raw[i], ends[i] = raw[x] + raw[y], ends[y]
        self.known: dict[int, bool] = {}
        self.known_rows: dict[bytes, tuple[int, np.ndarray]] = {}
        good: dict[int, bool] = {}
        for i in raw:  # halves come before what is made of them
            good[i] = i not in self.halves or (all(good[x] for x in self.halves[i]) and self._side_by_side(*self.halves[i], self.rank[i]))
        import ahocorasick

        inner = {raw[i]: i for i in raw if good[i] and not ends[i]}
        final = {raw[i]: i for i in raw if good[i] and ends[i]}
        #: Finds the pieces that end at each byte, as (size, piece if the word goes on, piece with the end mark).
        self.pieces = ahocorasick.Automaton()
        for piece in inner.keys() | final.keys():
            self.pieces.add_word(piece.decode("latin-1"), (len(piece), inner.get(piece, -1), final.get(piece, -1)))
        self.pieces.make_automaton()

    def _side_by_side(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether merging (up to the merge ``limit``) leaves the pieces ``a`` and ``b`` side by side.

        Undoes the merges inside both, latest first, and asks at each state
        whether the pieces at the border would have merged before the merge
        that was undone last; of equal merges the left one comes first.
        """
        merged, halves, rank = self.merged, self.halves, self.rank
        while True:
            crossing = merged.get((a, b))
            if crossing is not None and crossing < limit:
                return False
            if a in halves and (b not in halves or rank[a] > rank[b]):
                limit, a = rank[a], halves[a][1]
            elif b in halves:
                limit, b = rank[b] + 1, halves[b][0]
            else:
                return True

    def prefixes(self, words: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
        """Of each pre-token its ids, and the token count of each of its prefixes (as a pre-token of its own).

        ``last[k]`` is the last piece of what merging makes of the first k
        bytes if the word goes on.  There is one way to reach each k: with the
        one piece that can stand beside the last one where it begins.  A prefix
        ends with a piece that has the end mark, found in the same way.  What a
        word shares with the one before it, as sorted ones do, is not done again.
        """
        known, check, iterate = self.known, self._side_by_side, self.pieces.iter
        most = max(map(len, words), default=0) + 1
        last, count, start, counts, closes = ([0] * most for _ in range(5))
        first = [0] * most
        before = b""
        for word in words:
            n, same = len(word), 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            before = word
            last[same + 1 : n + 1] = [-1] * (n - same)
            counts[same:n] = [0] * (n - same)
            for stop, (size, inner, final) in iterate(word.decode("latin-1")):
                if stop < same:
                    continue
                at = stop + 1 - size
                if final >= 0 and not counts[stop]:
                    if at:
                        pair = last[at] << 32 | final
                        good = known.get(pair)
                        if good is None:
                            good = known[pair] = check(last[at], final)
                    if not at or good:
                        counts[stop], closes[stop], first[stop] = count[at] + 1, final, at
                if inner >= 0 and last[stop + 1] < 0:
                    if at:
                        pair = last[at] << 32 | inner
                        good = known.get(pair)
                        if good is None:
                            good = known[pair] = check(last[at], inner)
                        if not good:
                            continue
                    last[stop + 1], count[stop + 1], start[stop + 1] = inner, count[at] + 1, at
            ids, at = [closes[n - 1]], first[n - 1]
            while at:
                ids.append(last[at])
                at = start[at]
            row = counts[:n]
            if word in SPLIT_SUFFIXES:
                # Alone, an apostrophe and half a suffix are two pre-tokens.
                row[1] = 2
            yield ids[::-1], row

    def odd_pre_tokens(self, text: str) -> list[bytes | int]:
        """Pre-tokens of any text by the library's normaliser and pre-tokeniser, and ids of special tokens."""
        out: list[bytes | int] = []
        at = 0
        for special in self.special_at.finditer(text) if self.special_at else ():
            out += self.plain_pre_tokens(text[at : special.start()])
            out.append(self.special_ids[special[0]])
            at = special.end()
        return out + self.plain_pre_tokens(text[at:])

    def plain_pre_tokens(self, text: str) -> list[bytes]:
        names = self.names
        return [bytes([names[c] for c in word]) for word, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def words(self, words: list[bytes]) -> np.ndarray:
        """Cache entries of pre-tokens."""
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words], dtype=np.int64)
        return self.entries(data, end - np.diff(end, prepend=0), end)

    def row(self, word: bytes) -> tuple[int, np.ndarray]:
        """The number of tokens of a pre-token, and the counts of its prefixes."""
        found = self.known_rows.get(word)
        if found is None:
            # Learning the word may replace the arrays of the cache, so it comes first.
            entry = int(self.words([word])[0])
            at = self.cache.key_start[entry]
            found = int(self.cache.length[entry]), self.cache.row_pool[at : at + len(word)].copy()
            if len(word) <= KNOWN_BYTES:
                if len(self.known_rows) >= KNOWN_ROWS:
                    self.known_rows.clear()
                self.known_rows[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of any text, one pre-token after the other."""
        if not self.rows:
            return self.library.encode(text, add_special_tokens=False).ids
        parts = self.odd_pre_tokens(text)
        entry = iter(self.words([p for p in parts if not isinstance(p, int)]).tolist())
        out: list[int] = []
        for p in parts:
            if isinstance(p, int):
                out.append(p)
            else:
                e = next(entry)
                out += self.cache.pool[self.cache.start[e] : self.cache.start[e] + self.cache.length[e]].tolist()
        return out

    def pre_tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pre-tokens, lower-cased bytes, and which texts are left to the library."""
        kind = CLASS[data]
        odd = np.zeros(len(offsets) - 1, bool)
        low = LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = data[lead]
        low[lead] = np.where((second >= 0x80) & (second <= 0x9E), second + 0x20, second)
        strange = np.concatenate([np.flatnonzero(kind == OTHER), lead[(second == 0x97) | (second == 0xB7)]])
        raw = data.tobytes()
        for word in self.special:
            at = raw.find(word)
            while at >= 0:
                strange = np.append(strange, at)
                at = raw.find(word, at + 1)
        if len(strange):
            odd[np.searchsorted(offsets, strange, "right") - 1] = True
        cut = np.empty(len(data), bool)
        cut[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == DIGIT
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.append(np.flatnonzero(cut), len(data))
        word = kind[at[:-1]] != SPACE
        start, end = at[:-1][word], at[1:][word]
        return *self._apostrophes(low, kind, start, end, offsets), low, odd

    @staticmethod
    def _apostrophes(low, kind, start, end, offsets):
        alone = np.flatnonzero((low[start[:-1]] == ord("'")) & (end[:-1] - start[:-1] == 1) & (start[1:] == end[:-1]) & (kind[start[1:]] == LETTER))
        if not len(alone):
            return start, end
        alone = alone[np.searchsorted(offsets, start[alone], "right") == np.searchsorted(offsets, start[alone + 1], "right")]
        follow, size = start[alone + 1], end[alone + 1] - start[alone + 1]
        taken = np.zeros(len(alone), np.int64)
        for suffix in SUFFIXES:
            same = size >= len(suffix)
            for k, c in enumerate(suffix.encode()):
                same &= low[np.minimum(follow + k, len(low) - 1)] == c
            taken[same & (taken == 0)] = len(suffix)
        start, end = start.copy(), end.copy()
        end[alone] += taken
        start[alone + 1] += taken
        left = start < end
        return start[left], end[left]

    def entries(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Cache entries of pre-tokens, after learning new ones."""
        return self.cache.entries(self.hasher.spans(self.hasher.table[low], start, end), low, start, end, self._learn)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return self._ask(words)
        if len(self.known) > KNOWN_PAIRS:
            self.known.clear()
        order = sorted(range(len(words)), key=words.__getitem__)
        found: list[tuple[list[int], list[int]]] = [([], [])] * len(words)
        for k, x in zip(order, self.prefixes([words[k] for k in order]), strict=True):
            found[k] = x
        return np.array([i for ids, _ in found for i in ids], np.uint32), np.array([len(ids) for ids, _ in found], np.int64), np.array([c for _, row in found for c in row], np.int32)

    def _ask(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pre-tokens, many at a time."""
        ids, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(words), 4096):
            some = [w.decode("utf-8", "replace") for w in words[k : k + 4096]]
            found = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            length = np.diff(np.flatnonzero(self.ends[found]), prepend=-1)
            if len(length) != len(some) or length.sum() != len(found):
                each = [self.library.encode(w, add_special_tokens=False).ids for w in some]
                found, length = np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
            ids.append(found)
            lengths.append(length)
        return np.concatenate(ids), np.concatenate(lengths)

    def prefix_block(self, data: np.ndarray, offsets: np.ndarray):
        """Ends of the pre-tokens, token counts of the block up to each (one more, from 0), entries, the first pre-token of each text (one more), texts left out."""
        start, end, low, odd = self.pre_tokens(data, offsets)
        if odd.any():
            usable = ~odd[np.searchsorted(offsets, start, "right") - 1]
            start, end = start[usable], end[usable]
        entry = self.entries(low, start, end)
        counts = np.concatenate([[0], np.cumsum(self.cache.length[entry])])
        return end, counts, entry, np.searchsorted(start, offsets), odd

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of the texts of a block."""
        _, counts, _, first, odd = self.prefix_block(data, offsets)
        out = counts[first[1:]] - counts[first[:-1]]
        for i in np.flatnonzero(odd):
            out[i] = len(self.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
        return out

    def ids(self, data: np.ndarray, offsets: np.ndarray, tail: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, ``tail`` after each, and where each text's begin (one more)."""
        _, counts, entry, first, odd = self.prefix_block(data, offsets)
        ids = self.cache.pool[ragged(self.cache.start[entry], self.cache.length[entry])]
        bounds = counts[first]
        if not odd.any():
            n, k = len(bounds) - 1, len(tail)
            size = np.diff(bounds)
            where = bounds + k * np.arange(n + 1)
            out = np.empty(len(ids) + n * k, np.uint32)
            out[np.arange(len(ids)) + np.repeat(k * np.arange(n), size)] = ids
            for j, t in enumerate(tail):
                out[where[1:] - k + j] = t
            return out, where
        parts = []
        for i in range(len(bounds) - 1):
            own = self.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")) if odd[i] else ids[bounds[i] : bounds[i + 1]]
            parts.append(np.concatenate([np.asarray(own, np.uint32), np.array(tail, np.uint32)]))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
