"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a Catalyst expression over the whole text (length, symbol,
stop-word and line ratios), and :data:`RULES` is a plain table of bounds on
them.  ``quality_rules`` turns both into two chained projections, without a
shuffle and without user functions, so a scan streams through it.

Defined results: a null text counts as no words and fails the base rule, as
does an empty one.  Repeated rows get a result each.  Columns of the input
that are not named here pass through; a column that has the name of a result
is replaced by the result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import SPACE, WORD, let

WINDOW = 8

# Frequent function words of the four supported languages.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "was", "for", "on", "as", "at", "from", "it", "this", "are", "a",
    "der", "die", "das", "und", "ist", "in", "den", "von", "zu", "mit", "für", "ein", "eine", "im", "auf", "nicht", "auch", "sich", "dem", "des",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "qui", "dans", "pour", "pas", "sur", "au", "du", "en", "avec", "par",
    "el", "los", "las", "y", "del", "una", "por", "con", "para", "se", "su", "lo", "no", "como", "más", "o", "pero", "sus", "al", "mi",
]


class Rule(NamedTuple):
    """``low <= measure <= high`` for texts of at least ``from_words`` words; an open side is None."""

    name: str
    measure: str
    low: float | None
    high: float | None
    from_words: int = 20


# The bounds.
RULES = [
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", None, 0.5),
    Rule("shouted_words", "upper_word_ratio", None, 0.7),
    Rule("stop_words", "stop_word_ratio", 0.01, None, 50),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("long_lines_of_marks", "mark_line_ratio", None, 0.9),
]


def measures() -> dict[str, Column]:
    """Ratios over the base counts; all are defined once there is a word."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("__n_lines"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "upper_word_ratio": F.col("__n_upper") / n,
        "stop_word_ratio": F.col("__n_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "mark_line_ratio": F.col("__n_mark_lines") / lines,
    }


def verdict(rules: list[Rule], table: dict[str, Column]) -> Column:
    """All rules as one Boolean expression."""
    passed = F.lit(True)
    for rule in rules:
        value, within = table[rule.measure], F.lit(True)
        if rule.low is not None:
            within = within & (value >= rule.low)
        if rule.high is not None:
            within = within & (value <= rule.high)
        passed = passed & ((F.col("n_words") < rule.from_words) | within)
    return passed


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a ``window``-word window (a power of two) that occurs twice or more in ``words``.

    Windows are compared by a 64-bit hash of the words; chance equality in one
    text of 10,000 words has a probability of about 3e-12.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            marked = F.transform(s, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(pairs, lambda s: let(starts(s), total))

    def some(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    def doubled(hashes: Column, width: int) -> Column:
        """From hashes of ``width`` words at each place to those of ``2 * width``."""
        pairs = F.transform(F.sequence(F.lit(0), F.size(hashes) - width - 1), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + width)))
        return let(pairs, lambda h: some(h) if 2 * width == window else doubled(h, 2 * width))

    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1)))


def quality_rules(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with its counts, base_failed and kept; ``text`` stays."""
    rules = RULES if rules is None else rules
    keep = [c for c in docs.columns if c not in {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}]
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *keep,
        F.array_remove(F.split(body, f"{SPACE}+"), "").alias("__words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)).alias("__lines"),
    )
    counts = split.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(body, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").alias("__n_lines"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("__n_stop"),
        F.size(F.filter("__words", lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))).alias("__n_upper"),
        F.size(F.filter("__lines", lambda x: x.rlike(r"^\s*[-*•|]") | x.rlike(r"(\.\.\.|…)\s*$"))).alias("__n_mark_lines"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules, measures())).alias("kept")
    )
