"""Personal data in texts, found from anchors.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs before a
digit, the digit pairs around a dot or a gap, schemes and identifier cues.  From
each anchor a small parser walks to both sides, to the boundaries of the item,
and checks it.  What no anchor stands in is never looked at again.

Base kinds, each leftmost and not overlapping, as their patterns would match:

*   ``email``: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
*   ``ip``: four groups of digits, none over 255
*   ``card``: 16 to 19 digits with single gaps, valid by Luhn
*   ``phone``: ``+`` and 8 to 15 digits

Further kinds, which the parsers at schemes and cues add:

*   ``address``: a URL that names a user (``scheme://user:word@host``), and what follows ``mailto:``, ``tel:``, ``sip:``
*   ``account``: the value after a cue as ``password=``, ``token:``, ``iban``, ``account no.``; an IBAN must be valid by its check digits, a value must have a digit and six characters

Spans count code points, the end exclusive.  Everything works on the UTF-8 bytes,
in which the patterns' characters are single bytes.

Defined results: null counts as the empty text and has no spans; repeated rows are
searched each; other columns pass through, and one that has the name of a result
(spans) is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.llm.blocks import text_blocks
from tesserine.llm.common import bound_batches

#: All kinds in the order of reports; the first four are the base ones.
KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
#: Bytes of a text that the automaton takes at a time.
SEARCH_BYTES = 1 << 20

# Schemes, and cues of accounts and secrets (lower case).
URL_SCHEMES = ["http", "https", "ftp", "sftp", "ssh", "ldap", "smtp", "imap", "redis", "mongodb", "postgres", "postgresql", "mysql", "amqp"]
PLAIN_SCHEMES = ["mailto:", "tel:", "sip:", "sips:", "xmpp:"]
CUES = [
    "password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "api-key", "apikey", "api key", "access_key", "access key", "private_key",
    "iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "social security", "passport", "tax id", "customer id", "user id", "member id", "license no", "licence no",
]

DIGITS = frozenset(b"0123456789")
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
LOCAL = ALNUM | frozenset(b"._%+-")
LABEL = ALNUM | frozenset(b"-")
GAP = frozenset(b" -")
PHONE = DIGITS | frozenset(b" ().-")
#: What a URL, its part before the path, the name after a plain scheme, and the value of a cue consist of.
URL = ALNUM | frozenset(b"-._~:/?#[]@!$&*+,;=%")
AUTHORITY, NAME = URL - frozenset(b"/?#"), URL - frozenset(b":")
VALUE = ALNUM | frozenset(b"_-./+")
SEPARATOR = re.compile(rb"""[ \t]*(?:(no\.?|nr\.?|number)[ \t]*)?([:=#]?)[ \t]*["']?""", re.IGNORECASE)
IBAN = re.compile(rb"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: The shortest value after a cue.
LEAST_VALUE = 6

Span = tuple[int, int, int]


def _right(raw: bytes, at: int, allowed: frozenset[int]) -> int:
    """The end of the characters of ``allowed`` from ``at`` on."""
    n = len(raw)
    while at < n and raw[at] in allowed:
        at += 1
    return at


def _left(raw: bytes, at: int, allowed: frozenset[int], least: int) -> int:
    while at > least and raw[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: bytes) -> bool:
    """Whether the check digit (ASCII digits) is right."""
    odd = sum(digits[-1::-2]) - 48 * len(digits[-1::-2])
    return (odd + sum((2 * (d - 48)) // 10 + (2 * (d - 48)) % 10 for d in digits[-2::-2])) % 10 == 0


def email(raw: bytes, at: int, done: int) -> tuple[int, int, bool] | None:
    """The email around the at-sign at ``at``: start, end, whether it counts. What ends before ``done`` is taken."""
    start = _left(raw, at, LOCAL, done)
    end = _right(raw, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(raw) and raw[end] == 46 and (stop := _right(raw, end + 1, LABEL)) > end + 1:
        end, dots = stop, dots + 1
    return (start, end, True) if dots else None


def ip(raw: bytes, at: int, done: int) -> tuple[int, int, bool] | None:
    """The address whose first dot is right of the digit at ``at``."""
    start = _left(raw, at, DIGITS, done)
    end = _right(raw, at, DIGITS)
    good = int_at_most(raw[start:end], 255)
    for _ in range(3):
        if end >= len(raw) or raw[end] != 46 or (stop := _right(raw, end + 1, DIGITS)) == end + 1:
            return None
        good &= int_at_most(raw[end + 1 : stop], 255)
        end = stop
    return start, end, good


def int_at_most(digits: bytes, most: int) -> bool:
    digits = digits.lstrip(b"0")
    return len(digits) <= 3 and int(digits or b"0") <= most


def card(raw: bytes, at: int, done: int) -> tuple[int, int, bool] | None:
    """The chain of digits with single gaps from its first digit at or left of ``at``."""
    start = at
    while start > done and (raw[start - 1] in DIGITS or (raw[start - 1] in GAP and start - 1 > done and raw[start - 2] in DIGITS)):
        start -= 1
    end = at + 1
    while end < len(raw) and (raw[end] in DIGITS or (raw[end] in GAP and end + 1 < len(raw) and raw[end + 1] in DIGITS)):
        end += 1
    size = end - start - raw.count(b" ", start, end) - raw.count(b"-", start, end)
    return start, end, 16 <= size <= 19 and luhn(raw[start:end].replace(b" ", b"").replace(b"-", b""))


def phone(raw: bytes, at: int, done: int) -> tuple[int, int, bool] | None:
    """The number that the plus sign at ``at`` begins."""
    end = _right(raw, at + 2, PHONE)
    while end > at + 2 and raw[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return at, end, 8 <= sum(c in DIGITS for c in raw[at + 1 : end]) <= 15


def url(raw: bytes, at: int, done: int) -> tuple[int, int, bool] | None:
    """A URL with a user part; ``at`` is the colon after the scheme."""
    end = _right(raw, at + 3, AUTHORITY)
    user, sign, name = raw[at + 3 : end].rpartition(b"@")
    if not sign or not user or not _right(name, 0, LABEL):
        return None
    end = _right(raw, end, URL)
    while raw[end - 1] in b".,;:!?":
        end -= 1
    return _left(raw, at, ALNUM | frozenset(b"+.-"), done), end, True


def plain_scheme(raw: bytes, at: int, done: int) -> tuple[int, int, bool] | None:
    """What follows ``mailto:`` and the like; ``at`` is the colon."""
    end = _right(raw, at + 1, NAME)
    while end > at + 1 and raw[end - 1] in b".,;:!?":
        end -= 1
    name, start = raw[at + 1 : end], _left(raw, at, ALNUM, done)
    if raw[start : at + 1].lower().decode() not in PLAIN_SCHEMES or (b"@" not in name[1:-1] and sum(c in DIGITS for c in name) < 5):
        return None
    return start, end, True


def iban_valid(value: bytes) -> bool:
    value = value.replace(b" ", b"")
    return 15 <= len(value) <= 34 and int("".join(str(int(chr(c), 36)) for c in value[4:] + value[:4])) % 97 == 1


def account(raw: bytes, at: int, done: int) -> tuple[int, int, bool] | None:
    """The value after the cue that ends before ``at``: an IBAN, or what a sign or the word for number sets off."""
    gap = SEPARATOR.match(raw, at)
    start = gap.end()
    chain = IBAN.match(raw, start)
    for end in range(chain.end() if chain else 0, start + 14, -1):
        if (end == len(raw) or raw[end] not in ALNUM) and raw[end - 1] in ALNUM and iban_valid(raw[start:end]):
            return start, end, True
    if not (gap[1] or gap[2]):
        return None
    end = _right(raw, start, VALUE)
    while end > start and raw[end - 1] in b"./-+":
        end -= 1
    if end - start < LEAST_VALUE or not any(c in DIGITS for c in raw[start:end]):
        return None
    return start, end, True


def cued(raw: bytes, at: int, done: int, size: int) -> tuple[int, int, bool] | None:
    """``account``, if the cue of ``size`` characters is a word of its own or the end of a name with an underscore."""
    return None if at > size and raw[at - size - 1] in ALNUM else account(raw, at, done)


Parser = Callable[[bytes, int, int], tuple[int, int, bool] | None]


@lru_cache(1)
def anchors():
    """The automaton: each anchor gives the kind's number, its parser and where from its end the parser begins."""
    import ahocorasick

    found: dict[str, list[tuple[int, Parser, int]]] = {"@": [(0, email, 0)]}
    for a, b in product("0123456789", repeat=2):
        found.setdefault(f"{a}.{b}", []).append((1, ip, 2))
        for gap in ("", " ", "-"):
            found.setdefault(f"{a}{gap}{b}", []).append((2, card, 0))
    for a in "0123456789":
        found[f"+{a}"] = [(3, phone, 1)]
    for s in URL_SCHEMES:
        found[f"{s}://"] = [(4, url, 2)]
    for s in PLAIN_SCHEMES:
        found[s] = [(4, plain_scheme, 0)]
    for cue in CUES:
        found[cue] = [(5, partial(cued, size=len(cue)), -1)]
    automaton = ahocorasick.Automaton()
    for anchor, parsers in found.items():
        automaton.add_word(anchor, parsers)
    automaton.make_automaton()
    return automaton


#: A text without any of these has no span of any kind.
_SOME = re.compile(rb"[0-9@]")


def byte_spans(raw: bytes) -> list[Span]:
    """(kind, start, end) in bytes, by kind and start."""
    if not _SOME.search(raw):
        return []
    out: list[Span] = []
    done, automaton = [0] * len(KINDS), anchors()
    longest = max(map(len, (*CUES, *PLAIN_SCHEMES, *URL_SCHEMES))) + 3
    for begin in range(0, len(raw), SEARCH_BYTES):
        # Anchors that end in this piece; those that begin before it are seen as well.
        shift = max(0, begin - longest)
        lower = raw[shift : begin + SEARCH_BYTES].lower().decode("latin-1")
        for stop, parsers in automaton.iter(lower):
            stop += shift
            if stop < begin:
                continue
            for kind, parse, back in parsers:
                at = stop - back
                if at < done[kind]:
                    continue
                span = parse(raw, at, done[kind])
                if span is not None:
                    start, end, counts = span
                    done[kind] = end
                    if counts:
                        out.append((kind, start, end))
    return sorted(out)


def code_point_spans(raw: bytes) -> list[Span]:
    """(kind, start, end) in code points."""
    spans = byte_spans(raw)
    if not spans or raw.isascii():
        return spans
    inner = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)
    return [(kind, start - int(np.searchsorted(inner, start)), end - int(np.searchsorted(inner, end))) for kind, start, end in spans]


def find_personal_data(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``spans``: an array of (kind, start, end), by kind and start."""
    span_type = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
    gone = {"spans"} | (set() if keep_text else {text.lower()})
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone]
    arrow_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, data, offsets in text_blocks(batch.column(text)):
                raw = data.tobytes()
                at = offsets.tolist()
                rows += [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in code_point_spans(raw[a:b])] for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(rows, arrow_type)], [*(f.name for f in kept), "spans"])

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("spans", T.ArrayType(span_type, False))]))


def described(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (a frame with spans) with each span of the text replaced by its kind in angle brackets; of overlapping spans the earlier, then longer one counts."""
    order = F.array_sort(F.transform(F.col("spans"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        before = F.substring(F.col(text), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        taken = F.struct((-s["back"]).alias("at"), F.concat(done["out"], before, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
        return F.when(s["start"] >= done["at"], taken).otherwise(F.struct(F.greatest(done["at"], -s["back"]).alias("at"), done["out"].alias("out")))

    whole = F.aggregate(order, start, step, lambda done: F.concat(done["out"], F.substring(F.col(text), (done["at"] + 1).cast("int"), F.length(F.col(text)))))
    return found.withColumn(text, whole)
