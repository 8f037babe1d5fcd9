"""Small building blocks for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Spark evaluates an outer expression used in a lambda again for every element;
    a lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(size: Column) -> Column:
    """``[0, 1, ..., size - 1]``; an empty array for size 0."""
    return F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def prefix_sums(values: Column) -> Column:
    """Exclusive running sums of an array, by blocks so that long arrays stay cheap."""

    def with_values(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / _BLOCK)
        block_sums = F.transform(indices(n_blocks), lambda b: array_sum(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))

        def with_blocks(sums: Column) -> Column:
            starts = F.transform(sums, lambda _, b: array_sum(F.slice(sums, F.lit(1), b)))

            def with_starts(s: Column) -> Column:
                def start_of(_: Column, i: Column) -> Column:
                    block = F.floor(i / _BLOCK).cast("int")
                    return F.get(s, block) + array_sum(F.slice(v, block * _BLOCK + 1, i % _BLOCK))

                return F.transform(v, start_of)

            return let(starts, with_starts)

        return let(block_sums, with_blocks)

    return let(values, with_values)
