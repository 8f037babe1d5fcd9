"""Intake of arriving documents and runs as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.model import input_schema
from quirewise.operators.redact import pii_mask
from quirewise.session import shared_folder
from quirewise.sources.corpus import page_texts
from quirewise.sources.sinks import remove_folder


def stream_table(spark: SparkSession, root: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over the files of one table, be it one file or a folder of part files."""
    stream = spark.readStream.schema(input_schema(name)).option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(f"{root.rstrip('/')}/{name}.parquet*")


def stream_redact(documents: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Blank matches in arriving documents; stateless, the same expressions as the batch operator."""
    return pii_mask(documents, patterns)


def stream_dedupe(documents: DataFrame, delay: str, period: str) -> DataFrame:
    """``doc_id, page, h, arrived`` of the first arrival of every page hash in every period of time.

    Needs an ``arrived`` timestamp; of pages that arrive at one moment the smallest id and page is the first. A page comes
    out, and its state goes, once the watermark has passed the end of its period, so the state holds the hashes of the
    open periods and no more, however long the stream runs. Pages whose period has ended by then are late and left
    out. Copies within a batch are reduced before the shuffle, so a page with very many copies never meets in one task.
    """
    pages = documents.select("doc_id", "arrived", F.posexplode(page_texts(F.col("text"))).alias("_pos", "_page")).select(
        "arrived",
        F.struct("arrived", "doc_id", (F.col("_pos") + 1).cast("bigint").alias("page")).alias("_at"),
        F.sha2(F.coalesce("_page", F.lit("")), 256).alias("h"),
    )
    firsts = pages.withWatermark("arrived", delay).groupBy(F.window("arrived", period), "h").agg(F.min("_at").alias("first"))
    return firsts.select("first.doc_id", "first.page", "h", "first.arrived")


def open_firsts(state: DataFrame) -> DataFrame:
    """What ``stream_dedupe`` has found for periods that are still open."""
    return state.select("value.min.doc_id", "value.min.page", "key.h", "value.min.arrived")


def stream_history(history: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Runs per tool in tumbling windows; late rows past the watermark are dropped."""
    return (
        history.withWatermark("started_at", delay)
        .groupBy(F.window("started_at", width), "tool_id")
        .agg(F.count(F.lit(1)).alias("runs"))
        .select(F.col("window.start").alias("window_start"), "tool_id", "runs")
    )


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything there is now, into files of the shared folder, and read them back."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def open_counts(state: DataFrame) -> DataFrame:
    """What ``stream_history`` has counted in windows that are still open."""
    return state.select(F.col("key.window.start").alias("window_start"), "key.tool_id", F.col("value.count").alias("runs"))


def run_arrivals(
    parts: Sequence[DataFrame],
    build: Callable[[DataFrame], DataFrame],
    still_open: Callable[[DataFrame], DataFrame],
    name: str,
) -> DataFrame:
    """Let parts of a table arrive one after another and run a windowed stream over each, always from its checkpoint.

    The stream appends what the watermark has closed. What is open after the last part is read from its state, so
    every row that was not late is in the result, and no batch writes the result of an earlier one again. A part is late
    or not by the watermark that all parts before it have left. The landed files are removed when the run is over.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        result = build(spark.readStream.schema(schema).parquet(f"{root}/in"))
        query = (
            result.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    remove_folder(spark, f"{root}/in")
    closed = spark.read.schema(result.schema).parquet(f"{root}/out")
    return closed.unionByName(still_open(spark.read.format("statestore").load(f"{root}/state")))


def arrival_parts(df: DataFrame, key: str, parts: int = 4, slow: int = 7) -> list[DataFrame]:
    """Parts of about equal ranges of a whole-number key; keys that end in the digit ``slow`` come one part later."""
    least, most = df.agg(F.min(key), F.max(key)).first()
    if least is None:
        return [df]
    part = F.expr(f"(({key} - {least}L) * {parts}L) div {most - least + 1}L")
    part = F.least(part + (F.abs(F.col(key)) % 10 == slow).cast("int"), F.lit(parts - 1))
    return [df.where(part == n) for n in range(parts)]
