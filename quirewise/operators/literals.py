"""Long lists of literals in one pass over the text, by an automaton that holds them all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HITS = "array<struct<literal: int, start: int>>"
#: The automaton of this worker, by its literals.
_workers: dict[tuple[str, ...], object] = {}


def _automaton(literals: tuple[str, ...]):
    if literals not in _workers:
        import ahocorasick

        built = ahocorasick.Automaton()
        for number, literal in enumerate(literals):
            built.add_word(literal, (number, len(literal)))
        built.make_automaton()
        _workers.clear()
        _workers[literals] = built
    return _workers[literals]


def _checked(literals: Sequence[str]) -> tuple[str, ...]:
    if not literals:
        raise ValueError("no literals given")
    if "" in literals:
        raise ValueError("an empty literal matches nothing that could be shown")
    return tuple(dict.fromkeys(literals))


def _found(text: str | None, automaton) -> list[tuple[int, int]]:
    """``(literal, start)`` of what a scan for each literal by itself finds: from the left, without overlaps of its own."""
    last: dict[int, int] = {}
    out = []
    for end, (number, length) in automaton.iter(text or ""):
        start = end - length + 1
        if start >= last.get(number, 0):
            last[number] = end + 1
            out.append((number, start))
    return out


def literal_spans(doc_pages: DataFrame, literals: Sequence[str]) -> DataFrame:
    """All matches per page and literal, the same rows as ``pii_spans`` gives for ``text:`` patterns; no shuffle.

    The text is read once, however many literals there are. Matches of one literal do not overlap, those of different
    ones may. A null text has none; a literal that is given twice counts once. The list goes out with the tasks, so it is
    one that the driver holds.
    """
    wanted = _checked(literals)

    @F.pandas_udf(_HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(wanted)
        for texts in batches:
            yield pd.Series([[{"literal": n, "start": s} for n, s in _found(t, automaton)] for t in texts], dtype=object)

    named = F.array(*[F.lit(w) for w in wanted])
    found = doc_pages.select("doc_id", "page", F.explode(hits("text")).alias("_h")).select(
        "doc_id", "page", F.get(named, F.col("_h.literal")).alias("match"), F.col("_h.start").cast("bigint").alias("start")
    )
    end = (F.col("start") + F.length("match")).alias("end")
    return found.select("doc_id", "page", F.concat(F.lit("text:"), "match").alias("pattern"), "start", end, "match")


def literal_mask(df: DataFrame, literals: Sequence[str], column: str = "text") -> DataFrame:
    """Blank every character of a text column that lies in a match of one of the literals; no shuffle, null stays null."""
    wanted = _checked(literals)

    def blanked(text: str | None, automaton) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for start, stop in sorted((s, s + len(wanted[n])) for n, s in _found(text, automaton)):
            if stop > done:
                out += [text[done : max(start, done)], " " * (stop - max(start, done))]
                done = stop
        return "".join(out) + text[done:]

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(wanted)
        for texts in batches:
            yield pd.Series([blanked(t, automaton) for t in texts], dtype=object)

    return df.withColumn(column, mask(F.col(column)))
