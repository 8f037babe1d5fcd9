"""Run history and chains of tools."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recent_items(history: DataFrame, k: int = 20) -> DataFrame:
    """The k latest runs: every task keeps its own k before they meet."""
    return history.orderBy(F.col("started_at").desc(), "id").limit(k)


def recent_per_subject(history: DataFrame, k: int = 3) -> DataFrame:
    """The k latest runs per subject; the rank filter lets tasks drop rows before the shuffle."""
    latest = W.partitionBy("subject_id").orderBy(F.col("started_at").desc(), "id")
    return history.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


def upsert_latest(current: DataFrame, changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Insert, replacing rows of the same key: per key the row that is last in ``order`` stays."""
    rest = [c for c in current.columns if c != key]
    both = current.unionByName(changes)
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return latest.select(key, "_row.*")


def prune_older(history: DataFrame, cutoff: Column) -> DataFrame:
    """Drop runs strictly before the cutoff."""
    return history.where(F.col("started_at") >= cutoff)


def history_status(history: DataFrame) -> DataFrame:
    """Runs, failures and time spent per tool and status."""
    return history.groupBy("tool_id", "status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("value") > 100).alias("slow_runs"),
        F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("total_value"),
        F.max("value").alias("max_value"),
    )


def tool_chain(df: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Feed the output of one tool to the next; ``steps`` names the tools that ran, in order."""
    if not steps:
        raise ValueError("a chain needs at least one step")
    out = reduce(lambda acc, step: acc.transform(step[1]), steps, df)
    return out.withColumn("steps", F.array(*[F.lit(name) for name, _ in steps]))
