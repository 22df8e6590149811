"""Which of many short strings stand in which texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings, and characters of them, that one automaton may hold in each task.
MOST_NEEDLES, MOST_CHARACTERS = 200_000, 16 << 20


def fits(needles: DataFrame, needle: str) -> bool:
    """Whether the distinct strings of ``needles`` are few enough for one automaton."""
    some = needles.where(F.col(needle).isNotNull()).select(needle).distinct().limit(MOST_NEEDLES + 1)
    size = some.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(needle)), F.lit(0)).alias("characters")).first()
    return size["n"] <= MOST_NEEDLES and size["characters"] <= MOST_CHARACTERS


def holding(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """``texts`` with ``needle``: a row for each distinct string of ``needles`` that ``text`` contains (null contains none).

    Up to the bounds above the strings go to the tasks as one automaton, and each
    text is read once, whatever their number.  More of them are joined by a search
    for each pair; they are dealt out, not broadcast.
    """
    wanted = needles.where(F.col(needle).isNotNull()).select(needle).distinct()
    if not fits(wanted, needle):
        return texts.join(wanted.hint("shuffle_replicate_nl"), F.contains(F.col(text), F.col(needle)))
    names = sorted(r[0] for r in wanted.collect())
    schema = T.StructType([*texts.schema.fields, T.StructField(needle, T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names:
            if name:
                automaton.add_word(name, name)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, value in enumerate(batch.column(text)):
                value = value.as_py()
                if value is None:
                    continue
                met = {name for _, name in automaton.iter(value)} if len(automaton) else set()
                if "" in names[:1]:
                    met.add("")
                rows += [i] * len(met)
                found += sorted(met)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(found, pa.string())], [*batch.schema.names, needle])

    return texts.mapInArrow(search, schema)
