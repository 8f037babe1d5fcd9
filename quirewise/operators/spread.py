"""Numbering, running totals and joins that hold when one key owns a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = 65_536
HOT_ROWS = 1_000_000


def _bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)))


def running_total(
    df: DataFrame, group: Sequence[str], order: str, value: str, out: str, width: int = BUCKET
) -> DataFrame:
    """Exclusive running sum of ``value`` per group in the order of a whole-number column.

    A group is cut into buckets of ``width`` order values. Bucket sums are small enough for a window over the group;
    the window over rows never sees more than one bucket, whatever the size of the group.
    """
    group = list(group)
    cut = _bucketed(df, order, width)
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*group, "_bucket")
        .agg(F.sum(value).alias("_sum"))
        .select(*group, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        cut.join(starts, [*group, "_bucket"])
        .withColumn(out, (F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_start")).cast("bigint"))
        .drop("_bucket", "_start")
    )


def number_within(df: DataFrame, group: Sequence[str], order: str, out: str, width: int = BUCKET) -> DataFrame:
    """Dense numbers from 1 per group in the order of a unique whole-number column."""
    numbered = running_total(df.withColumn("_one", F.lit(1)), group, order, "_one", out, width)
    return numbered.withColumn(out, F.col(out) + 1).drop("_one")


def hot_keys(df: DataFrame, on: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``rows`` rows and ``_parts``, over how many sub-keys of ``rows`` rows each is to be spread.

    There is at most one such key per ``rows`` rows of the table. Spark broadcasts them if they turn out small.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    return counts.select(*on, F.ceil(F.col("_n") / rows).alias("_parts"))


def spread_join(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    hot_in: DataFrame | None = None,
    rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi join where single keys of ``many`` may own a large share of its rows.

    Rows of hot keys are spread over sub-keys, as many as their number asks for, and their partners repeated for each;
    other keys join plainly.
    Hot keys are looked for in ``hot_in``, a cheaper table with at least as many rows per key, or in ``many`` itself.
    """
    on = list(on)
    if how not in ("inner", "left"):
        raise ValueError(f"spread_join supports inner and left, not '{how}'")
    hot = hot_keys(many if hot_in is None else hot_in, on, rows)
    left = (
        many.join(hot, on, "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*salt_by), F.col("_parts")), F.lit(0)))
        .drop("_parts")
    )
    all_salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)).cast("bigint") - 1)
    right = (
        one.join(hot, on, "left")
        .withColumn("_salt", F.explode(all_salts))
        .drop("_parts")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")
