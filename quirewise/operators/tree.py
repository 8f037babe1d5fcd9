"""Following parent links to their end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quirewise.sources.sinks import stage_table


def climb(start: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], name: str) -> DataFrame:
    """Resolve rows that still point upwards (``_at`` is not null) through the rows they point at.

    ``merge(pending, known)`` joins each pending row with the row at its ``_at`` and takes over what that one has found
    so far, its pointer included. So the reach of a row doubles each round: a chain of a thousand links takes ten. A round
    writes the rows that were pending, and nothing else, to the shared folder. As every round ends at least one row that
    has an end, a round that ends none leaves only rows that hang in a ring; they keep their ``_at`` and it is for the
    caller to say what that means.
    """
    known = stage_table(start, name)
    done, pending = known.where("_at is null"), known.where("_at is not null")
    left = pending.count()
    while left:
        moved = stage_table(merge(pending, done.unionByName(pending)), name)
        done, pending = done.unionByName(moved.where("_at is null")), moved.where("_at is not null")
        before, left = left, pending.count()
        if left == before:
            break
    return done.unionByName(pending)
