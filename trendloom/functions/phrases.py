"""Which of many phrases a text may hold, in one pass whatever their number.

An automaton over the longest word of each phrase finds candidates, an Arrow function that
gives their numbers; the exact patterns then run for these only. Letters are compared as
regular expressions without case do, so no phrase that a pattern finds is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from trendloom.functions.batches import list_slices, slices


def folded(text: str) -> str:
    """Letters that match one another without case become one; both dotless and dotted i do."""
    return text.replace("ı", "i").replace("İ", "i").casefold()


def _automaton(phrases: Sequence[str]):
    import ahocorasick

    keys: dict[str, list[int]] = {}
    for i, phrase in enumerate(phrases):
        keys.setdefault(folded(max(phrase.split(), key=len)), []).append(i)
    found = ahocorasick.Automaton()
    for key, numbers in keys.items():
        found.add_word(key, numbers)
    found.make_automaton()
    return found


def _numbers(automaton, text: str | None) -> list[int]:
    return sorted({i for _, numbers in automaton.iter(folded(text)) for i in numbers}) if text else []


def candidates(phrases: Sequence[str]) -> Callable[[Column], Column]:
    """A column function: text to the numbers of phrases that it may hold, rising. Its result must be a
    column of a table before lambdas see it. Spark runs it where it is written, once: a filter above
    would have it run again below."""
    phrases = tuple(phrases)

    @F.arrow_udf(ArrayType(IntegerType()))
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(phrases)
        for texts in batches:
            yield pa.array([_numbers(automaton, t) for own in slices(texts) for t in own], pa.list_(pa.int32()))

    return find.asNondeterministic()


def candidates_in_each(phrases: Sequence[str]) -> Callable[[Column], Column]:
    """The same for an array of texts: (at, phrase) pairs, in order."""
    phrases = tuple(phrases)

    @F.arrow_udf(ArrayType(StructType().add("at", IntegerType()).add("phrase", IntegerType())))
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(phrases)
        for lists in batches:
            pairs = [[(at, i) for at, t in enumerate(texts or ()) for i in _numbers(automaton, t)] for part in list_slices(lists) for texts in part.to_pylist()]
            flat = [p for own in pairs for p in own]
            kind = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.int32()), pa.array([p[1] for p in flat], pa.int32())], names=["at", "phrase"])
            yield pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, pairs))], pa.int32()), kind)

    return find.asNondeterministic()


def literals(values: Sequence) -> Column:
    """A constant array, to look numbers up in."""
    return F.array(*map(F.lit, values))
